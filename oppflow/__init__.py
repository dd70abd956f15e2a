"""oppflow: opportunity-tracking analytics as Spark DataFrame operators."""

from oppflow.session import configure, durable, release, scratch_path, shared_dir

__all__ = ["configure", "durable", "release", "scratch_path", "shared_dir"]
