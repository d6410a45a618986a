"""Registered queries against their SQL counterparts, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUICK = ("detect_r05 count_r02 redact_r14 redact_r22 redact_static redact_full_doc redact_full_corpus redact_custom documents_redacted "
         "pseudonym_dictionary_corpus decode_text binary_sniff sanitize_path manifest_rollup counts_by_doc audit_expected "
         "candidate_lines synth_mix_050 top_errors line_reassemble file_roundtrip").split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR), entry.oracle_sql(), entry.queries()


def test_every_query_has_a_counterpart(oracle):
    own = {name for name in oracle[2] if not name.startswith("op") and name != "pipeline"}
    assert own <= set(oracle[1]) <= set(oracle[2])


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, oracle, name):
    con, sql, queries = oracle
    outcome = compare(spark, con, SF_DIR, name, queries[name], sql[name])
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text"]
