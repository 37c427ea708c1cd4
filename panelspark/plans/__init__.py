"""Jobs composed of operators, and model preparation and fitting."""
