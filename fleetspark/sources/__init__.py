"""fleetspark.sources"""
