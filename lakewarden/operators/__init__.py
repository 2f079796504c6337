"""lakewarden.operators"""
