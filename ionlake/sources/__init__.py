"""ionlake.sources"""
