"""Operators: DataFrame in, DataFrame (or small fitted statistics) out."""
