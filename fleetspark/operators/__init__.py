"""fleetspark.operators"""
