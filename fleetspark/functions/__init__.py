"""fleetspark.functions"""
