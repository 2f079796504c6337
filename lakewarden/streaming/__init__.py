"""lakewarden.streaming"""
