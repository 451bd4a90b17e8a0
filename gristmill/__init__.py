"""Curation and validation of JSON-like corpora as Spark jobs."""

from gristmill.plans.curation import curate_corpus, curate_table
from gristmill.session import configure
from gristmill.spec import Spec, SpecError

__all__ = ["Spec", "SpecError", "configure", "curate_corpus", "curate_table"]
