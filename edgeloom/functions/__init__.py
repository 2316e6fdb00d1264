"""Column functions."""

from .scalar import char_code, log2_weight, one_hot, pad_code, parse_epoch, register, sigmoid, softmax

__all__ = ["char_code", "log2_weight", "one_hot", "pad_code", "parse_epoch", "register", "sigmoid", "softmax"]
