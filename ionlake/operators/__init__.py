"""ionlake.operators"""
