"""Streams of files through the row-local operators."""

from answergrid.streaming.streams import append_stream, known_header, stream_files, stream_grid

__all__ = ["append_stream", "known_header", "stream_files", "stream_grid"]
