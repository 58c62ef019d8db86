"""Column functions of the engine."""

from .codec import (  # noqa: F401
    block_decode,
    block_decode_partial,
    block_encode,
    block_encode_into,
    block_error,
    canonical,
    container_decode,
    container_encode,
    frame_decode,
    frame_encode,
    frame_error,
    header_fields,
    legacy_encode,
    register,
    skippable_frame,
    xxh32,
    xxh64,
    zero_runs,
)
from .scalars import *  # noqa: F401,F403
