"""Numpy kernels over single images, and the functions that run them over image columns."""
