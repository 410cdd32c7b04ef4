"""Record linkage, draws, unit assignment, promotion, audit and lifecycle, as DataFrame operators."""
