"""Registered queries of the operators: name -> f(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from . import bpe, compress_classifier, decontaminate, hmm, html_extract, jaccard_join, lexical_search, line_dedup, mixing, near_embeddings, secrets, token_counts, whitening
from .oracles import ORACLE_SQL  # noqa: F401

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_html_extract(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op9_compress_classifier(spark, sf_dir):
    return compress_classifier.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


VOCABULARY = "word_bpe_49k.json"


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary, on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op4_token_counts(spark, sf_dir, vocabulary=None):
    return token_counts.counts(_table(spark, sf_dir, "documents"), token_counts.load(vocabulary or _vocabulary(VOCABULARY)))


@_query
def op5_hmm(spark, sf_dir):
    return hmm.score(_table(spark, sf_dir, "documents"))


@_query
def op3_secrets(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


@_query
def op8_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query
def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


@_query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.groups(_table(spark, sf_dir, "documents"))


@_query
def op6_near_embeddings(spark, sf_dir):
    return near_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_whitening(spark, sf_dir):
    return whitening.digest(_table(spark, sf_dir, "embeddings"))


@_query
def op13_bpe(spark, sf_dir, vocabulary=None):
    return bpe.digest(_table(spark, sf_dir, "documents"), bpe.load(vocabulary or _vocabulary(VOCABULARY)))
