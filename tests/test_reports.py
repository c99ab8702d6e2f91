"""The files of a run's reports hold the texts that a plain reading gives."""

import glob

from veinwork.sources import reports

RUN = "pos bigint, question string, category string, status string, evidence_count int, top_score double, anchor string, top_title string, answer string, fallback boolean, old_status string, old_top_title string, old_answer string, compare string, compare_notes string"
ROWS = [
    (1, "q<1>", "", "OK", 2, 0.5, "a", "T", "an\nswer", False, "MISS", "O", "old", "IMPROVED", "x"),
    (2, "q2", "c", "MISS", None, None, None, None, "未找到\n依据", True, "OK", None, "o" * 500, "REGRESSED", "worse"),
    (1000, None, None, "ERR", 0, 1.0, "", "T'", None, False, None, None, None, "NEW_ONLY", None),
]


def read(folder):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/part-*")))


def test_bundle(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, RUN)
    reports.write_bundle(rows, str(tmp_path), "Run", compared=True)
    assert sorted(p.rsplit("=")[-1] for p in glob.glob(f"{tmp_path}/pages/page=*")) == ["001", "002", "1000"]
    assert read(f"{tmp_path}/pages/page=001") == (
        "# 第 001 题（未分类）\n\n## 问题\nq<1>\n\n## 旧版结果\n- old_status: MISS\n- old_top_title: O\n- old_answer_snippet: old\n\n## 新版结果\n- status: OK\n- evidence_count: 2\n- top_score: 0.5\n- anchor: a\n\n"
        "## Top1 证据标题\nT\n\n## 对比结论\n- compare: IMPROVED\n- notes: x\n\n## 回答\nan\nswer\n"
    )
    assert "- old_answer_snippet: " + "o" * 480 + "...\n" in read(f"{tmp_path}/pages/page=002")
    assert read(f"{tmp_path}/report.md").split("\n") == [
        "# Run", "", "## 总体结果", "- TOTAL: 3", "- OK: 1", "- MISS: 1", "- ERR: 1", "- FALLBACK: 1", "- EMPTY_EVIDENCE: 2", "- ANCHOR_HIT: 1", "- AVG_TOP_SCORE: 0.25", "", "## 新旧对比", "- IMPROVED: 1", "- REGRESSED: 1", "- SAME: 0", "- CHANGED: 0",
        "", "## MISS 样本", "- 问题：q2", "  - top_title: ", "  - answer_snippet: 未找到 依据", "", "## 回退样本", "- 问题：q2", "  - old_status: OK -> new_status: MISS", "  - notes: worse", "",
    ]
    printed = read(f"{tmp_path}/print.html")
    assert printed.startswith("<article class='card'><h2>001. 未分类</h2><div><b>问题:</b> q&lt;1&gt;</div>") and "<b>Top1:</b> T&#x27;</div>" in printed and printed.index("002. c") < printed.index("1000. ")


def test_without_an_old_run_and_without_rows(spark):
    rows = spark.createDataFrame(ROWS, RUN)
    lines = [r.line for r in reports.report(rows.where("status = 'OK'"), "R").orderBy("part", "n").collect()]
    assert lines[:4] == ["# R", "", "## 总体结果", "- TOTAL: 1"] and len(lines) == 11
    assert "旧版" not in rows.select(reports.page()).first()[0]
    assert [r.line for r in reports.report(rows.limit(0), "R").orderBy("part", "n").collect()][-1] == "- AVG_TOP_SCORE: 0.0"
