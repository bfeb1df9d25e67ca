"""The encoder of :mod:`fathomweave.functions.encode`, for the operators on tokens."""

from fathomweave.functions.encode import ID_TYPE, Encoder, default_tokenizer, pack, shared_encoder

__all__ = ["ID_TYPE", "Encoder", "default_tokenizer", "pack", "shared_encoder"]
