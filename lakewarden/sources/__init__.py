"""lakewarden.sources"""
