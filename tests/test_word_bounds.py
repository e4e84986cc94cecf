"""Word edges beside letters of other scripts, as SQL sees them."""

from oracle import rows_of, sql_rows

from fathomline import registry

SAID = ["possède la clé", "él dé élan", "thé theé the", "únd und", "ède", "mayé shall not", "áthe é", None, "de", "mañana de"]


def test_cues_beside_accents(spark, tmp_path):
    rows = [(i // 3, i % 3, "user" if i % 2 else "assistant", t) for i, t in enumerate(SAID)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    folder = tmp_path / "sql"
    folder.mkdir()
    (part,) = (tmp_path / "conversations.parquet").glob("*.parquet")
    (folder / "conversations.parquet").write_bytes(part.read_bytes())
    for name in ("cue_scores", "route_confusion", "route_decision"):
        assert rows_of(registry.QUERIES[name](spark, str(folder))) == sql_rows(registry.ORACLES[name], str(folder)), name


def test_modality_beside_accents(spark, tmp_path):
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(["émay x", "mayé y", "it must", "müst must"])], "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/d")
    (part,) = (tmp_path / "d").glob("*.parquet")
    folder = tmp_path / "sql"
    folder.mkdir()
    (folder / "documents.parquet").write_bytes(part.read_bytes())
    assert rows_of(registry.QUERIES["clause_modality"](spark, str(folder))) == sql_rows(registry.ORACLES["clause_modality"], str(folder))
