"""fleetspark.streaming"""
