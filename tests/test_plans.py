"""Plans that hold at scale: no shuffle where none is needed, no nested loops over data, columns pruned at the scan."""

import re

import pytest

from millwatch.plans import detection, linking, texts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [texts.chunk_documents, texts.chunk_sections, texts.topic_tags, texts.doc_type_vote, linking.clip_index, linking.row_contract, detection.array_runs])
def test_rows_stay_where_they_are(spark, query):
    assert "Exchange" not in plan(query(spark, SF))


@pytest.mark.parametrize("query", [detection.carve_windows, detection.events_quantile, linking.video_match_reuse, linking.video_match_once, linking.tag_lookup, linking.topic_retrieval])
def test_joins_are_on_keys(spark, query):
    assert not re.search("Cartesian|NestedLoop", plan(query(spark, SF)))


def test_only_the_columns_that_count_are_read(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(texts.chunk_documents(spark, SF)))
    assert re.search(r"ReadSchema: struct<o_custkey:bigint>", plan(linking.split_prefix(spark, SF)))


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(linking.topic_retrieval(spark, SF))


def test_energy_of_windows_moves_sums_only(spark):
    told = plan(detection.sliding_rms(spark, SF))
    assert len(re.findall(r"\bExchange\b", told)) <= 3 and len(re.findall("FileScan", told)) <= 2
    assert "SortMergeJoin" not in told


@pytest.mark.parametrize("query", [detection.events_quantile, detection.events_zscore, detection.events_labelled])
def test_no_run_is_ordered_or_gathered_whole(spark, query, monkeypatch):
    """Windows by run alone are over summaries: of the rest, all that was written on the way was by run and part of it."""
    from millwatch.operators import selection
    from millwatch.operators import timeseries as ts

    seen = []
    keep = ts.saved

    def noted(df, name):
        seen.append((name, plan(df)))
        return keep(df, name)

    monkeypatch.setattr(ts, "saved", noted)
    monkeypatch.setattr(selection, "SMALL", 50)
    query(spark, SF)
    for name, told in seen:
        if name in ("events-apart", "events-begun"):  # a row or two of each segment or span
            continue
        for keys in re.findall(r"Window \[.*?\], \[(run_id#\d+)\]", told):
            raise AssertionError(f"{name} is ordered by {keys} alone")
