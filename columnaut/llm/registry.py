"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprint, licenses, mixing, near_dedup, packing, quality, secrets, toxicity, url_filters, warc

_MODULES = [quality, packing, secrets, toxicity, mixing, licenses, fingerprint, url_filters, warc, near_dedup]


def queries() -> dict:
    import corpus_pipeline

    return {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
