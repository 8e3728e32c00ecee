"""Scalar functions: text, time formatting and pixel kernels."""
