"""shroud: corpus-scale personal-data detection and de-identification on Spark.

Documents are DataFrame rows; detected entities are an ``array<struct>`` span
column (or an exploded span table); replacement is a projection plus, where a
persisted mapping is used, a distinct / anti-join / join-back.
"""

from shroud.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
