"""Tables in the shared folder (see sources.store)."""

from ledgerloom.sources.store import materialize, new_path, remove, shared_dir

__all__ = ["materialize", "new_path", "remove", "shared_dir"]
