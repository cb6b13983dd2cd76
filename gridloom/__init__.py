"""gridloom: object-based analysis of gridded and geospatial data on PySpark.

Rasters are relations of pixels, segments are relations of labels or outlines, and every
stage is a lazy DataFrame that Catalyst plans.  The subpackage ``llm`` holds the operators
for training corpora; nothing outside it imports it.
"""
