"""Query and upkeep plans composed of the operators."""
