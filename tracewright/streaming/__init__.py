"""tracewright.streaming"""
