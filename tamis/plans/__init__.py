"""Rule sets, seat plans, and the pipeline from applications to allotments."""
