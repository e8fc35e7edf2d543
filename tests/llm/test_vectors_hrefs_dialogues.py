"""Vector links, link filters and review dialogues against brute force."""

import hashlib
import random
from collections import defaultdict

import brute
import numpy as np
import pytest

from sightline.llm.dialogues import CONTROLS, dialogue_digests, format_turns, read_turns, text_part
from sightline.llm.hrefs import RULES, href_verdicts, label_rule, place_rule
from sightline.llm.vectors import tables_needed, vector_links
from pyspark.sql import functions as F


def vectors():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 32))
    rows = [c + 0.12 * rng.standard_normal(32) for c in centres for _ in range(25)]
    rows += [rows[0]] * 5 + list(rng.standard_normal((60, 32)))
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 5.0]]
    out += [(900 + i, v) for i, v in enumerate(odd)]
    return [*out, (3, out[3][1]), (None, out[4][1])]


def links_of(rows, limit=0.95):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, float) if ok else None
        unit.append(a / np.sqrt((a * a).sum()) if ok else None)
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= limit] for i, a in enumerate(unit)]
    roots = brute.components(len(rows), lambda i: near[i])
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r].append(i)
    return [(i, len(n), min(least[r], default=None)) for (i, _), n, r in zip(rows, near, roots, strict=True)]


@pytest.mark.parametrize("block", [2048, 8])
def test_vector_links_match_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "candidate_id BIGINT, score_components ARRAY<DOUBLE>, class INT, n_links INT")
    got = vector_links(frame, block=block).collect()
    want = links_of(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["candidate_id"] is not None and r["candidate_id"] == r["component_id"]) for r in got)
    found, all_links = sum(r["n_links"] for r in got), sum(n for _, n, _ in want)
    assert found <= all_links and found >= 0.98 * all_links
    assert sorted((str(r[0]), r[2]) for r in got) == sorted((str(i), c) for i, _, c in want)
    assert vector_links(frame.limit(0)).count() == 0


def test_recall_is_planned_for_any_number_of_vectors():
    for n in (0, 1, 10**4, 10**9):
        bits, tables = tables_needed(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.995


HREFS = [
    "http://a.example.net/en/1", "http://example.net/enx", "http://EXAMPLE.com/de/x?q=://b.net/", "https://sub.org/fr/#x", "https://sub.org/FR/",
    "http://notexample.com/de/", "http://net", "http://x.net", "http://x.net/", "http://x.net/en/", "http://www.casino-win.net/fr/", "http://casino-win.org",
    "http://a.casino-win.org/fr/", "http://casino-wins.org/", "no scheme", "", None, "://", "x://y://z/p?q", "http://user@ads-track.com:80/a", "http://ads-track/",
    "http://x.net/" + "a" * 100_000, "http://ex\nample.org/fr/\nb", "http://sub.org/fr/", "http://sub.org/fr/",
]


def plain_verdict(href):
    _, mark, rest = (href or "").partition("://")
    host = rest
    for end in "/?#":
        host = host.split(end)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = brute.ascii_lower(host) if mark else ""
    path = path if mark else ""
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    if best:
        return host, path, best[1], best[0]
    for label in sorted(["casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track"], key=lambda x: (-len(x), x)):
        if label in host.split("."):
            return host, path, label, "block"
    return host, path, None, "allow"


def test_hrefs_match_plain_rules(spark):
    frame = spark.createDataFrame([(i, h, "was") for i, h in enumerate(HREFS)] + [(None, HREFS[0], "was")], "item_id BIGINT, href STRING, rule STRING")
    got = href_verdicts(frame)
    assert got.columns == ["item_id", "href", "link_host", "link_path", "rule", "verdict"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        str((i, h, *plain_verdict(h))) for i, h in [*enumerate(HREFS), (None, HREFS[0])]
    )
    assert href_verdicts(frame.limit(0)).count() == 0


def test_many_rules_are_found_through_their_rarest_token(spark):
    rng = random.Random(2)
    rules = [place_rule("block", f"s{rng.randrange(50)}.example.org", f"/d{i}/") for i in range(300)] + [label_rule("spam-farm")]
    frame = spark.createDataFrame([(i, f"http://s{rng.randrange(60)}.example.org/d{rng.randrange(320)}/x") for i in range(500)], "item_id BIGINT, href STRING")
    got = {r["item_id"]: r["rule"] for r in href_verdicts(frame, spark.createDataFrame(rules, RULES)).collect()}
    names = {r[0] for r in rules}
    for r in frame.collect():
        name = r["href"][len("http://") : -1]
        assert got[r["item_id"]] == (name if name in names else None)


def turns_table(spark, rows):
    frame = spark.createDataFrame(rows, "candidate_id BIGINT, seq BIGINT, role STRING, said STRING")
    return frame.select("candidate_id", "seq", "role", text_part(F.col("said")).alias("parts"))


def test_dialogues_read_back_as_they_were(spark):
    rng = random.Random(3)
    bits = [*CONTROLS, "\\", "\\\\", "\n", "<", "|", "ok", "é", "<|end|>\n", "<|turn|>user\n", "$1", ""]
    rows = [(i % 9, i, rng.choice(["user", "assistant", None, "a\nb\\", "<|x|>"]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(400)]
    rows += [(1, 3, "user", None), (1, 3, "user", None), (None, 0, "assistant", "x"), (None, None, "user", "y"), (50, 0, "assistant", "\\<|" * 100_000)]
    formatted = format_turns(turns_table(spark, rows))
    back = sorted((str(r["candidate_id"]), str(r["seq"]), r["role"], r["text"], r["loss_text"]) for r in read_turns(formatted).collect())
    assert back == sorted((str(c), str(s), r or "", t or "", (t or "") if r == "assistant" else "") for c, s, r, t in rows)
    segments = [r["segment"] for r in formatted.collect()]
    assert all(s.count("<|") == 2 and "</s>" not in s and "[/INST]" not in s for s in segments)
    got = {str(r["candidate_id"]): r for r in dialogue_digests(read_turns(formatted)).collect()}
    by = defaultdict(list)
    for c, s, r, t in rows:
        by[str(c)].append((-1 if s is None else s, r or "", t or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), want)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r["formatted_chars"] for r in got.values()) == sum(map(len, segments))
    assert dialogue_digests(read_turns(format_turns(turns_table(spark, [])))).count() == 0


def test_parts_become_ordered_placeholders(spark):
    parts = [("text", "see ", None, None, None), ("image", None, "a1", "image/png", None), ("text", " and <|image:0|>", None, None, None),
             ("document", None, "d1", "application/pdf", 3), ("audio", None, "s1", "audio/wav", None), ("document", None, "d2", None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(
        [("c", 0, "user", parts), ("c", 1, "assistant", None), ("c", 2, "assistant", [])],
        "candidate_id STRING, seq BIGINT, role STRING, parts ARRAY<STRUCT<kind STRING, text STRING, artifact_id STRING, media_type STRING, pages INT>>",
    )
    first, second, third = format_turns(frame).orderBy("seq").collect()
    assert first["segment"] == "<|turn|>user\nsee <|image:0|> and <\\|image:0|><|document:1|><|audio:2|><|document:3|><|:4|><|end|>\n"
    assert [(a["number"], a["kind"], a["artifact_id"]) for a in first["attachments"]] == [(0, "image", "a1"), (1, "document", "d1"), (2, "audio", "s1"), (3, "document", "d2"), (4, "", None)]
    assert first["expanded_tokens"] == 576 + 3 * 1024 + 750 + 1024
    assert second["segment"] == third["segment"] == "<|turn|>assistant\n<|end|>\n" and second["expanded_tokens"] == 0
