"""Outlines to beats: odd lines, against a plain walk over the lines."""

import re

from footage_lake.operators import scripts

ODD = [
    "x\n### early\n- 地点： a \n## 一\n\n### 场1-1\n- 地点：x\n- 地点: y\n-内容：c\rd\n#\n- 时间：lost\n###\n## \n- 时间：lost\n### 场2-9 \n - 情绪：e\n- dialogue: \"q\"\n- 关键动作：走，，看、 听\n## 二\n## 三\n####\n### z",
    "", "## only", "### a ### b\n- time: t - time: u\n- 内容：v", "- 地点：none\n###x\n#### y\n   ### s\n-  location：  l  \n- key two: 3\n-：\n- 内容：",
]


def walked(text):
    out, act, beat = [], "", None
    for line in (x.strip(" ") for x in text.split("\n")):
        if line.startswith("#"):
            act = line[3:].strip(" ") if line.startswith("## ") else act
            beat = None
            if line.startswith("### "):
                beat = {"act": act, "beat_id": line[4:].strip(" ")}
                out.append(beat)
        elif beat is not None and (m := re.search(r"^-\s*([^：:\s]+)[：:]\s*([^\n\r\u0085  ]+)$", line, re.A)):
            beat[m[1]] = m[2].strip(" ")
    return out


def test_outlines(spark):
    got = {}
    for r in scripts.parse_outline(spark.createDataFrame(list(enumerate(ODD)), "script_id int, text string")).collect():
        got.setdefault(r["script_id"], {})[r["beat_seq"]] = r
    for k, text in enumerate(ODD):
        want = walked(text)
        assert sorted(got.get(k, {})) == list(range(1, len(want) + 1))
        for n, w in enumerate(want, 1):
            r = got[k][n]
            assert (r["act"], r["beat_id"], r["location"], r["time"], r["content"], r["emotion"]) == (w["act"], w["beat_id"], w.get("地点", w.get("location", "")), w.get("时间", w.get("time", "")), w.get("内容", ""), w.get("情绪", ""))
    assert got[0][3]["key_actions"] == ["走", "看", "听"] and got[0][3]["key_dialogue"] == "q"


def test_beats_are_parsed_where_their_text_is(spark):
    beats = scripts.parse_outline(spark.createDataFrame([(1, ODD[0])], "script_id int, text string"))
    assert "Exchange" not in beats._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_walked_by_lengths_alone(spark, monkeypatch):
    """Lines of distinct numbers meet their chunks once; lines of one number go with their text, as before."""
    lines = [(s, 3 * n, "x" * ((7 * n + s) % 40)) for s in range(3) for n in range(60)]
    seen, gated = [], scripts.gated
    monkeypatch.setattr(scripts, "gated", lambda rows, *a: seen.append(rows.columns) or gated(rows, *a))
    kind = "script_id int, line_no int, line string"
    of = lambda rows: {(r["script_id"], r["chunk_no"]): r["chunk"] for r in scripts.chunked_lines(spark.createDataFrame(rows, kind), 100).collect()}
    got, more = of(lines), of([*lines, (9, 1, "b"), (9, 1, "a"), (9, 0, None)])
    assert "line" not in seen[0] and "line" in seen[1] and {k: v for k, v in more.items() if k[0] != 9} == got and more[9, 0] == "\na\nb"
    for s in range(3):
        whole = "\n".join(x[2] for x in lines if x[0] == s)
        want = spark.createDataFrame([(whole,)], "text string").select(scripts.chunks(scripts.F.col("text"), 100)).first()[0]
        assert [got[s, k] for k in range(len(want))] == want
