"""Quality, decontamination, packing, licences, secrets, dialogues and archives against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm_tables import plain
from pyspark.sql import functions as F

from skylag.llm import chat, decontaminate, licenses, packing, quality, secrets, warc, workers
from skylag.llm.queries import good_label, table, vocabulary

# --- quality ---------------------------------------------------------------------------------------


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.score(docs, fit, good_label()).join(held, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_held_out_toxic_rows_are_rejected(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.score(docs, fit, good_label()).join(docs.select("doc_id", "lang", "text"), "doc_id").join(held, "doc_id").collect()

    def kept(rows):
        return sum(r["kept"] for r in rows) / len(rows)

    insult = re.compile(r"(?i)\b(trash|pathetic|idiot|disgusting|worthless|clown|loser|scum|stupid|moron)\b")
    prose = [r for r in judged if r["quality"] == 1]
    good, toxic = ([r for r in prose if r["toxic"] == t] for t in (0, 1))
    insulting = [r for r in toxic if insult.search(r["text"])]
    assert kept(good) > 0.98 and kept(insulting) < 0.02
    assert kept([r for r in judged if r["quality"] == 0]) < 0.05
    assert kept(toxic) < 0.15  # the others have no word in common that non-toxic rows lack
    for lang in ("de", "en", "es", "fr"):
        assert kept([r for r in good if r["lang"] == lang]) > 0.97, lang


def test_no_length_outweighs_words_against_a_text(spark):
    prose = "The quick and the slow went over this and that hill. " * 3
    texts = [f"{prose} word{i}" for i in range(60)] + [f"{prose} vile{' so' * (i % 3)}" for i in range(20)] + [prose * 200 + "Vile!"]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, good int")
    rows = {r["doc_id"]: r for r in quality.score(plain(spark, texts), labels, F.col("good") == 1).collect()}
    assert rows[80]["word_weight"] < -2 and rows[0]["word_weight"] == 0
    assert not rows[80]["kept"] and sum(rows[i]["kept"] for i in range(60)) >= 57


@pytest.mark.parametrize("k", [1, 50, 999, 5000])
def test_exactly_k_are_drawn_and_drawn_again_alike(spark, k):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score(docs, labels, good_label(), k=k).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(kept) == min(k, len(rows))
    best = sorted(rows, key=lambda r: -r["score"])[: len(kept)]
    assert {r["doc_id"] for r in best} == kept
    again = quality.select_documents(docs.repartition(5), labels, good_label(), k=k)
    assert {r["doc_id"] for r in again.select("doc_id").collect()} == kept


def test_order_keys_follow_scores():
    scores = np.array([-np.inf, -1e300, -2.5, -1e-12, 0.0, 1e-12, 3.0, 1e300, np.inf])
    assert (np.diff(quality._keys(scores).astype(object)) > 0).all()


def test_log_weight_is_the_sum_over_the_grams(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample = quality.labelled(labels, good_label())
    ratio = quality.fit_ratio(docs, sample)
    good = {r["doc_id"] for r in sample.where("good = 1").collect()}
    raw, target, grams = Counter(), Counter(), {}
    for r in docs.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        bucket, _ = quality._grams(data, np.array([0, len(data)]))
        grams[r["doc_id"]] = bucket
        raw.update(bucket.tolist())
        target.update(bucket.tolist() if r["doc_id"] in good else [])
    spread = quality.PRIOR * (1 << quality.BUCKET_BITS)
    targets, raws = sum(target.values()) + spread, sum(raw.values()) + spread
    for b in raw:
        p, q = (target[b] + quality.PRIOR) / targets, (raw[b] + quality.PRIOR) / raws
        assert ratio[b] == pytest.approx(math.log(p / q))
    for r in quality.weigh(docs, ratio).collect():
        assert r["n_grams"] == len(grams[r["doc_id"]])
        assert r["log_weight"] == pytest.approx(ratio[grams[r["doc_id"]]].sum())


# --- decontamination -------------------------------------------------------------------------------


def _words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_hits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = ["the", "Of", "and", "été", "İx", "rare1", "rare2", "K"]
    items = [" ".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(25)] + [None, "", "--", "solo", "The THE"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(30)] + [None, "", "solo"]
    texts += [f"{texts[i]}, {items[i]}! {texts[i + 1]}" for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "the of"), (2, items[2])], "item_id long, text string")
    for window in (4, 13):
        rows = {r["doc_id"]: r for r in decontaminate.contamination(plain(spark, texts), bench, window).collect()}
        for i, text in enumerate(texts):
            w, hit, ids = _words(text), set(), set()
            for k, item in enumerate(items):
                v = _words(item)
                n = min(window, len(v))
                for a in range(len(v) - n + 1) if n else ():
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == v[a : a + n]:
                            hit.update(range(b, b + n))
                            ids.add(str(k))
            r = rows[i]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(ids)), (window, text)
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_contaminated_rows_go(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = plain(spark, [item.upper(), "clean words only", item + " x" * 2000, None])
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns


def test_a_long_run_of_one_anchor_is_hit_whole(spark):
    docs = plain(spark, ["the " * 20_000, "the " * 12, "other"])
    items = spark.createDataFrame([(1, "The " * 14), (2, "the " * 13 + "end")], "item_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert rows == {0: (20_000, 20_000, 2), 1: (12, 0, 0), 2: (1, 0, 0)}


# --- packing ---------------------------------------------------------------------------------------


def _ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_hold_the_ids_of_the_whole_text(spark):
    odd = [None, "", "it's ÉCOLE x　y z", "é Å ẞ ǅ İ", "<|endoftext|> <|startoftext|>x", "a\x1cb\x85c\x0bd", "Σίσυφος ΟΔΟΣ \U0001f600‍"]
    texts = odd + [r["text"] for r in table(spark, SF, "documents").limit(60).collect()]
    rows = packing.tokenise(plain(spark, texts), vocabulary(), tokens=100).collect()
    for i, text in enumerate(texts):
        ids = _ids(text)
        want = [(k, s, len(p := ids[s : s + 100]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 100))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i) == want


def test_parts_of_words_are_tokenised_once_in_a_task(monkeypatch):
    from tokenizers import Tokenizer

    plain_call = Tokenizer.from_file(vocabulary())
    chunks = [["The cat isn't 42, [SEP] naïve !", "the CAT"], ["", "cat the [SEP] 24 naïve"], ["isn't the dog 4"]]
    asked, calls = [], packing._Words._ids
    monkeypatch.setattr(packing._Words, "_ids", lambda self, texts: asked.append(texts) or calls(self, texts))
    for kept in (packing.KEPT, 0):
        monkeypatch.setattr(packing, "KEPT", kept)
        words, sent = packing._Words(vocabulary()), []
        for chunk in chunks:
            asked.clear()
            got = [np.frombuffer(raw, "<u4")[:-1].tolist() for raw in packing._documents(words, pa.array(chunk))]
            assert got == [plain_call.encode(t, add_special_tokens=False).ids for t in chunk]
            sent.append(" ".join(t for texts in asked for t in texts))
        assert ("the" in sent[1]) is (kept == 0) and "dog" in sent[2] and ("naïve" in sent[1]) is (kept == 0)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents,cost", [(2048, 2048**2), (3, 2048**2), (2048, 2048**2 // 3 + 2048**2 // 2)])
def test_every_capacity_holds_and_few_sequences_are_used(spark, rule, documents, cost):
    rng = np.random.default_rng(7)
    lengths = [int(x) for x in np.minimum(2048, rng.exponential(500, 3000) + 1)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing._PIECE_SQL)
    rows = packing.pack(pieces, 2048, documents, cost, rule=rule, group=1500).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        alone = len(parts) == 1
        assert sum(n for _, n in parts) <= 2048 and len(parts) <= documents and (alone or sum(n * n for _, n in parts) <= cost)
    if documents == 2048 and cost == 2048**2:
        assert len(filled) <= math.ceil(sum(lengths) / 2048) * 1.02 + 2


@pytest.mark.parametrize("doc_id", [5, None])
def test_equal_rows_spread_over_all_groups(spark, doc_id):
    rows = [(doc_id, 0, 0, 1, 9)] * 30_000 + [(i, 0, 0, 7, i) for i in range(100, 10_100)]
    found = packing.pack(spark.createDataFrame(rows, packing._PIECE_SQL), group=2000).collect()
    assert Counter((r["doc_id"], r["length"]) for r in found) == Counter((r[0], r[3]) for r in rows)
    groups = Counter(r["sequence_id"] >> 32 for r in found)
    assert len(groups) == 20 and max(groups.values()) < 1.3 * 2000


def test_unknown_rule_is_refused():
    with pytest.raises(ValueError):
        packing.Packer(np.ones((1, 3), np.int64), (1, 1, 1), "first")


# --- licences --------------------------------------------------------------------------------------


def test_licences_are_found_and_inherited_from_the_nearest_folder(spark):
    filler = "plain words about nothing in particular " * 20
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/code", filler),
        (3, "a/c/LICENSE", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!"),
        (4, "a/c/d/code", filler),
        (5, "code", filler),
        (6, "a/c/own", filler + "\nLicensed under CC BY-NC 4.0.\n" + filler),
        (7, "ab/code", None),
        (8, None, filler),
    ]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {k: (r["licence"], r["how"]) for k, r in out.items()} == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"),
        5: (None, "none"), 6: ("CC-BY-NC-4.0", "own"), 7: (None, "none"), 8: (None, "none"),
    }
    assert out[2]["licensed_by"] == "a" and out[4]["licensed_by"] == "a/c" and out[1]["score"] == 1.0


def test_licence_files_of_real_length_are_found_and_inherited(spark):
    whole = [name for name in licenses.TEXTS if not name.endswith(".header")]
    code = "def run(x): return x + 1\n" * 40
    files, want = [], {}
    for k, name in enumerate(whole):
        text = f"{name} project\n\nCopyright (c) 2021-2024 Some One. All rights reserved.\n\n" + "\n# ".join(licenses.TEXTS[name].splitlines())
        files += [(2 * k, f"{name}/LICENSE", text.replace("holder", "owner")), (2 * k + 1, f"{name}/src/a/code", code)]
        want |= {2 * k: (name, "own"), 2 * k + 1: (name, "inherited")}
    for k, name in enumerate((name for name in licenses.TEXTS if name.endswith(".header")), 100):
        files.append((k, f"heads/{name}", licenses.TEXTS[name] + code * 10))
        want[k] = (name.removesuffix(".header"), "own")
    files += [(200, "heads/bare", code), (201, "part/LICENSE", licenses.TEXTS["GPL-3.0"][:2000]), (202, "part/code", code)]
    files += [(203, "long/code", code * 50 + licenses.TEXTS["MIT"] + code * 50), (204, "long/other", code), (205, "e", "")]
    want |= {200: (None, "none"), 202: (None, "none"), 203: ("MIT", "own"), 204: (None, "none"), 205: (None, "none")}
    out = {r["doc_id"]: (r["licence"], r["how"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {k: out[k] for k in want} == want


def test_every_planted_notice_is_found(spark):
    docs = table(spark, SF, "documents").withColumn("path", F.lit("x/y"))
    found = {r["doc_id"]: r["licence"] for r in licenses.scan(docs).where("how = 'own'").collect()}
    lines = {"MIT License": "MIT", "CC BY-NC 4.0": "CC-BY-NC-4.0", "GNU General Public License": "GPL-3.0", "Apache License": "Apache-2.0"}
    for r in docs.collect():
        named = {v for k, v in lines.items() if k in r["text"]}
        assert (found.get(r["doc_id"]) in named) if named else r["doc_id"] not in found


def test_anchors_lose_no_window():
    matcher = licenses.Matcher(licenses.TEMPLATES, 1000, {"the": 900, "under": 300, "license": 20, "version": 50, "this": 700, "work": 90, "is": 800})
    rng = np.random.default_rng(5)
    pool = sorted({t for part in matcher.parts.values() for t in part} | {"noise", "words"})
    for _ in range(300):
        listed = rng.choice(pool, rng.integers(1, 25)).tolist()
        best = 0.0
        for name, part in matcher.parts.items():
            for s in range(max(1, len(listed) - len(part) + 1)):
                unit = matcher._unit(Counter(listed[s : s + len(part)]))
                best = max(best, round(sum(w * matcher.vectors[name].get(t, 0) for t, w in unit.items()), 6))
        assert matcher.best(" ".join(listed))[1] == (best if best >= matcher.threshold else 0.0)


# --- secrets ---------------------------------------------------------------------------------------


def _base(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


#: What the operator shall do, written out here and not read from it.
PLACEHOLDERS = r"((?i:example|placeholder|changeme|xxxx)|[/_=+-])+"
SHORT_NUMBERS = r"[0-9]{1,4}([/_=-]+[0-9]{1,4})+"


def _harmless(s):
    if re.fullmatch(PLACEHOLDERS, s) or re.fullmatch(SHORT_NUMBERS, s):
        return True
    letters = re.fullmatch(r"[A-Za-z/_=+-]+", s)
    return bool(letters) and not re.search(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6}", s) and not re.search(r"[a-z][A-Z][a-z][A-Z]", s)


def _entropy(text, base):
    w, out = 20, []
    for _, pattern, group, least in secrets.KINDS:
        text = re.sub(pattern, lambda m: " " * len(m.group()) if len(m.group(group)) >= least else m.group(), text)  # noqa: B023
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s = m.group()
        bits = 3.0 if re.fullmatch(r"[0-9/_=+-]+", s) or re.fullmatch(r"[0-9A-Fa-f]+", s) else 3.9
        need = math.floor(bits * w * 1_000_000)
        hot = []
        for i in range(len(s) - w + 1):
            total = sum(round(n * math.log2(n) * 1_000_000) for n in Counter(s[i : i + w]).values())
            if round(w * math.log2(w) * 1_000_000) - total >= need:
                hot.append(i)
        if hot and not _harmless(s[hot[0] : hot[-1] + w]):
            out.append((m.start() + hot[0], 3, m.start() + hot[-1] + w, "entropy"))
    return out


def _spans(spark, texts):
    return {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(plain(spark, texts))).collect()}


def test_secrets_of_any_class_are_seen_and_harmless_runs_are_not(spark):
    found = ["qWmZrTbXkLpVnHsYcFdG", "example_key=aK9dL2mQ8xZ7pR4tB6nW1", "docs/example/aK9dL2mQ8xZ7pR4tB6nW1", "93847-56102-93748-56012", "0F1E2D3C4B5A69788796"]
    clean = ["example_placeholder_changeme", "2024-01-02/2025-03-04/1999", "documentation/chapters/introduction_by_example", "AnotherWordForQuickBrownFoxes", "x" * 40]
    spans = _spans(spark, found + clean)
    assert all("entropy" in spans[i] for i in range(len(found))) and all(spans[i] == "" for i in range(len(found), len(found + clean)))
    assert spans[0] == "entropy:0:20" and spans[3] == "entropy:0:23"


def test_many_matches_in_one_text(spark):
    rng = np.random.default_rng(5)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 16)) for _ in range(20_000)]
    text = " ".join(hexes)
    spans = _spans(spark, [text])[0].split(",")
    assert len(spans) == 20_000 and spans[-1] == f"hex:{17 * 19_999}:{17 * 19_999 + 16}"


def test_spans_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=")
    parts = ["token", "PassWord=", "secret : '", "api_key=", "apikey:", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "é\U0001f600", " ", "\n", "=", "token=secret=abcdefghijklmnop", "token=password: abcdefghijklmnop", "EXAMPLE"]
    texts = [None, "", "token=" + "a" * 11, "token=" + "a" * 12]
    for _ in range(150):
        bits = [str(rng.choice(parts)) if rng.random() < 0.6 else "".join(rng.choice(alphabet, rng.integers(1, 45))) for _ in range(rng.integers(1, 9))]
        texts.append("".join(bits))
    texts += ["".join(rng.choice(list("0123456789ABCDEF"), 30)) for _ in range(20)] + ["".join(rng.choice(list("0123456789"), 30)) for _ in range(5)]
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(plain(spark, texts))).collect()}
    n_entropy = 0
    for i, text in enumerate(texts):
        base = _base(text or "")
        more = _entropy(text or "", base)
        n_entropy += len(more)
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert rows[i]["spans"] == joined(base + more), text
        assert rows[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b[3] == k for b in base) for k in ("assign", "access", "hex")]
    assert n_entropy > 20


# --- dialogues -------------------------------------------------------------------------------------


def test_each_speaker_sees_itself_as_assistant(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"),
        (1, 4, None, "who?"), (2, None, "cat", "x"), (3, 0, "system", "alone"), (None, 0, "dan", "lost"),
    ]
    turns += [(4, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(600)]
    rows = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    seen: dict[tuple, list] = {}
    for r in rows:
        seen.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(seen) == {(1, "ann"), (1, "bob"), (2, "cat"), (4, "ann"), (4, "bob")}
    for (_, me), parts in seen.items():
        parts.sort(key=lambda r: r["start"])
        whole = "".join(r["rendered"] for r in parts)
        assert [r["turn"] for r in parts] == sorted(r["turn"] for r in parts)
        for r in parts:
            assert whole[r["start"] : r["end"]] == r["rendered"]
            head = "assistant" if r["speaker"] == me else "system" if r["speaker"] == "system" else f"user name={r['speaker']}"
            assert r["rendered"].startswith(f"<|im_start|>{head}\n") and r["rendered"].count("<|") == 2
            if r["speaker"] == me:
                assert whole[r["mask_start"] : r["mask_end"]] == r["rendered"].split("\n", 1)[1][:-1]
            else:
                assert r["mask_start"] is None and r["mask_end"] is None
    assert len(seen[1, "ann"]) == 5


# --- archives --------------------------------------------------------------------------------------

RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string"


def test_canonical_urls(spark):
    same = ["http://www.Host.example:80/a/?b=2&a=1&utm_source=x#top", "https://host.example/a?a=1&b=2", "HOST.example:443/a/?a=1&&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://h/A", None]], "url string").select(warc.canonical_url(F.col("url"))).collect()
    assert [r[0] for r in rows] == ["host.example/a?a=1&b=2"] * 3 + ["h/A", None]


def test_revisits_meet_the_latest_earlier_response(spark):
    tag = lambda t: {"ETag": t, "X-Old": "1", "Cache-Control": "old"}
    records = [
        (1, "http://h/a", 10, "response", 200, tag('"1"'), "one"),
        (2, "http://h/a", 20, "response", 200, tag('"2"'), "two"),
        (3, "http://h/a", 20, "response", 206, tag('"part"'), "part"),
        (4, "https://www.h/a/#x", 15, "revisit", 304, {"etag": 'W/"1"', "Cache-Control": "new", "Set-Cookie": "c"}, None),
        (5, "http://h/a", 20, "revisit", 304, {"ETag": '"1"'}, None),
        (6, "http://h/a", 5_000_000, "revisit", 304, {"ETag": '"1"'}, None),
        (7, "http://h/a", 5_000_001, "revisit", 304, None, None),
        (8, "http://h/a", 5, "revisit", 304, {}, None),
        (9, None, 30, "revisit", 304, {}, None),
        (10, "http://h/a", None, "revisit", 304, {}, None),
        (11, "http://h/b", 7, "response", 200, {"Last-Modified": "d", "ETag": "e"}, "b"),
        (12, "http://h/b", 8, "revisit", 304, {"last-modified": "d", "LAST-MODIFIED": "d"}, None),
    ]
    out = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(records, RECORD)).collect()}
    assert {k: (r["refers_to"], r["outcome"]) for k, r in out.items()} == {
        4: (1, "resolved"), 5: (1, "resolved"), 6: (2, "validator mismatch"), 7: (2, "unchecked"), 8: (None, "no earlier response"),
        9: (None, "no earlier response"), 10: (None, "no earlier response"), 12: (11, "resolved"),
    }
    assert out[4]["headers"] == {"etag": 'W/"1"', "x-old": "1", "cache-control": "new"} and out[4]["digest"] == "one"
    assert out[6]["headers"] is None and out[6]["digest"] is None


def test_one_hot_url_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    records = []
    for i in range(3000):
        url = "http://hot/" if rng.random() < 0.6 else f"http://h{rng.integers(20)}/"
        ts = int(rng.integers(0, 5000))
        full = rng.random() < 0.3
        records.append((i, url, ts, "response" if full else "revisit", 200 if full else 304, {}, f"d{i}" if full else None))
    for r in warc.resolve(spark.createDataFrame(records, RECORD)).collect():
        earlier = [(x[2], x[0]) for x in records if x[3] == "response" and x[1] == r["url"] and x[2] < r["ts"]]
        assert (r["refers_ts"], r["refers_to"]) == (max(earlier) if earlier else (None, None))


# --- memory of workers -----------------------------------------------------------------------------


def test_small_batches_change_no_row_and_end_with_their_block(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([batch.num_rows] * batch.num_rows)], ["id", "n"])

    sizes = {}
    with workers.small_batches(spark, 1 << 20):
        sizes["small"] = texts.mapInArrow(workers.lean(run), "id long, n long").collect()
    sizes["usual"] = texts.mapInArrow(workers.lean(run), "id long, n long").collect()
    assert spark.conf.get(name) == before
    assert [r["id"] for r in sizes["small"]] == [r["id"] for r in sizes["usual"]] == list(range(400))
    assert max(r["n"] for r in sizes["small"]) < 200 < max(r["n"] for r in sizes["usual"])
