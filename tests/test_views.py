"""Views, imports by extension and run folders."""

import os
from datetime import datetime

import pytest
from litspark.operators import annotate, project, views


def test_views(spark):
    rows = [(f"a{i % 3}", f"p{i}", i / 100 if i % 7 else None, "MODEL_RELEVANT" if i % 2 else "MODEL_NOT_RELEVANT", "m1" if i % 5 else None, i % 4 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "article_id string, paragraph_id string, semantic_score double, status string, llm_model string, evidence_valid boolean")
    score = lambda r: r[2] or 0.0
    want = sorted((r for r in rows if score(r) >= 0.1 and r[0] == "a1" and r[3] == "MODEL_RELEVANT"), key=lambda r: (-score(r), r[0], r[1]))
    assert list(map(tuple, views.view(df, "a1", 0.1, "MODEL_RELEVANT", show=25).collect())) == want[:25]
    assert views.view(df, model="m1", evidence=True, show=None).count() == sum(r[4] == "m1" and r[5] for r in rows)
    assert views.view(df, evidence=False, show=None).count() == 60 and views.view(df).count() == 50
    assert "TakeOrderedAndProject" in views.view(df)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        views.view(df, show=7)
    assert views.choices(df, "llm_model") == ["m1"]
    with pytest.raises(ValueError):
        views.choices(df, "paragraph_id", 10)


FORM = """---
format: x
---
## Trecho 1

paragraph_id: p9
document_id: d
text_hash: h9

### Texto
words

- [x] 2
- [ ] 3

### Observação opcional
fine
---
"""


def test_import_by_extension(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"paragraph_id": "p1", "annotator_id": "x", "label_1": true, "label_3": true, "annotation_note": "n"}\n{broken\n{"paragraph_id": "p2", "annotator": "y", "labels": [0, 2], "text_sha256": "h"}\n{"paragraph_id": ""}\n')
    (tmp_path / "b.CSV").write_text('paragraph_id,labels,annotator_id\np3,"1; 4",z\np4,"0,5",z\n')
    (tmp_path / "c.md").write_text(FORM)
    read = lambda name: {r.paragraph_id: r for r in annotate.import_file(spark, str(tmp_path / name)).collect()}
    a, b, c = map(read, ("a.jsonl", "b.CSV", "c.md"))
    assert set(a) == {"p1", "p2"} and (a["p1"].classes, a["p1"].status, a["p1"].note, a["p1"].annotator_id) == ([1, 3], "valid", "n", "x")
    assert a["p2"].status == "valid" and (a["p2"].annotator_id, a["p2"].text_hash) == ("y", "h")
    assert (b["p3"].classes, b["p3"].status, b["p4"].status, b["p3"].text_hash) == ([1, 4], "valid", "invalid", "")
    assert (c["p9"].classes, c["p9"].text_hash, c["p9"].note, c["p9"].annotator_id) == ([2], "h9", "fine", "")
    assert annotate.import_file(spark, str(tmp_path / "b.CSV")).columns == annotate.import_file(spark, str(tmp_path / "c.md")).columns


def test_run_folders_and_settings(spark, tmp_path):
    run = project.run_id(datetime(2024, 5, 6, 7, 8, 9))
    assert run == "run_2024_05_06_070809"
    made = project.run_folders(spark, str(tmp_path), run)
    assert all(os.path.isdir(p) for p in made.values()) and made["processed"] == made["paragraphs"]
    assert project.default_config(top_k=5)["top_k"] == 5 and project.default_config()["top_k"] == 20
    with pytest.raises(ValueError):
        project.default_config(nonsense=1)


def test_markdown_files_come_whole(spark, tmp_path):
    from litspark.sources import readers

    (tmp_path / "one.md").write_text("# A\n\nline\nlast")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "x.txt").write_text("no")
    assert [tuple(r) for r in readers.markdown_files(spark, str(tmp_path)).collect()] == [("one", "# A\n\nline\nlast")]
