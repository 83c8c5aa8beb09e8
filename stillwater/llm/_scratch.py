"""Intermediate tables in the folder that the cluster shares (see ``stillwater.scratch``)."""

from stillwater.scratch import Scope, discard, materialize, new_path, shared_dir, width

__all__ = ["Scope", "discard", "materialize", "new_path", "shared_dir", "width"]
