"""cairn.streaming"""
