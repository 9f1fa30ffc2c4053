"""Where intermediate results go: the folder of ``spark.checkpoint.dir``, which driver and executors share."""

from ..sources.shared import new_path, saved, shared_dir, table

__all__ = ["new_path", "saved", "shared_dir", "table"]
