"""How the inverted lists of phrases lie in their files."""

import pyarrow.parquet as pq

from scoreloom.llm import phrases
from scoreloom.llm.common import written


def test_row_groups_hold_few_blocks(spark, monkeypatch):
    """A task that makes many blocks writes them in row groups of a bounded size, which is what a reader holds."""
    made = {}

    def kept(df, name, **options):
        made[name] = written(df, name, **options)
        return made[name]

    monkeypatch.setattr(phrases, "written", kept)
    monkeypatch.setitem(phrases.ROW_GROUPS, "parquet.block.size", 1 << 16)
    texts = spark.createDataFrame([(" ".join(f"w{k * 37 + i}" for i in range(400)), f"l{k}") for k in range(60)], "text string, lang string").coalesce(1)
    assert phrases.collocations(texts, block=400).count() >= 0
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made["phrase-lists"].inputFiles()]
    assert sum(m.num_rows for m in groups) == 60 and sum(m.num_row_groups for m in groups) > 2
