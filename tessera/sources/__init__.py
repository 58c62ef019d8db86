"""Reading and writing files of frames."""

from .files import dictionary_from, dictionary_of, generated, read_files, read_results, sample_files, write_results  # noqa: F401
from .frame_source import FrameSource, register  # noqa: F401
