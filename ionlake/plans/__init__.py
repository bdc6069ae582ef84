"""ionlake.plans"""
