"""ionlake.streaming"""
