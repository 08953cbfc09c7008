"""The numbered queries next to their SQL on the smallest tables, and what each must return."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import compare, connect  # noqa: E402
from treecorpus.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "page_id host path rule verdict", "op2": "doc_id n_lines n_dropped kept_sha256",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id held_out score predicted",
    "op5": "query_id rank vec_id score", "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "vec_id n_links component_id kept", "op8": "doc_id held_out score predicted",
    "op9": "doc_id fingerprint component_id", "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11": "query_id rank vec_id score", "op13": "lang rank phrase a l r n score", "op12": "word form root n n_near form_n",
}


def test_all_are_registered():
    registered = entry.queries()
    assert sorted(name.split("_")[0] for name in QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) <= set(registered) and "pipeline" in registered


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, name):
    status, note, _, _ = compare(spark, connect(SF), name, SF)
    assert status == "OK", note


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(QUERIES[name](spark, SF).columns)
