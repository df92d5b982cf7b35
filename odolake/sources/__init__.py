"""Reading recordings, storing them and keeping their catalog."""

from .store import RecordingStore

__all__ = ["RecordingStore"]
