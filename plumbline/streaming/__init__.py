"""Counts over streams: slot counts are sums, so they are kept by window; gates are not, so they run on finished windows."""
