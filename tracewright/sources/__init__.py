"""tracewright.sources"""
