"""ionlake.functions"""
