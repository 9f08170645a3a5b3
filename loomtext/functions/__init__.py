"""loomtext.functions"""
