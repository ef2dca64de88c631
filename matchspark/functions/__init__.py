"""Column functions and keyed-order helpers shared by the operators."""
