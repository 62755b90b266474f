"""Registered queries of the training-data operators: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shroud.llm.conversations import op13_conversations
from shroud.llm.decontam import op1_decontam
from shroud.llm.exactdup import OP12_SQL, op12_exactdup
from shroud.llm.langid import op2_langid
from shroud.llm.mixing import op9_mix
from shroud.llm.nndescent import op3_nndescent
from shroud.llm.paragraphs import op5_paragraphs
from shroud.llm.quality import op4_quality
from shroud.llm.secrets import op8_secrets
from shroud.llm.simhash import op10_simhash
from shroud.llm.substrings import op7_substrings
from shroud.llm.warc import OP6_SQL, op6_warc
from shroud.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_langid": op2_langid,
    "op3_nndescent": op3_nndescent,
    "op4_quality": op4_quality,
    "op5_paragraphs": op5_paragraphs,
    "op6_warc": op6_warc,
    "op7_substrings": op7_substrings,
    "op8_secrets": op8_secrets,
    "op9_mix": op9_mix,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_exactdup": op12_exactdup,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": OP6_SQL,
    "op12_exactdup": OP12_SQL,
}
