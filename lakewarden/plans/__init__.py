"""lakewarden.plans"""
