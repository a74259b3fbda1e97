"""Whole jobs built from the operators: clips, compilations, full talks, translations, sinks."""
