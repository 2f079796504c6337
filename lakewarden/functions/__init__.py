"""lakewarden.functions"""
