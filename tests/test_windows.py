"""Token windows against the rule, token by token."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from fathomline.operators import windows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_hand(text, header, tokens, overlap):
    encoder = Tokenizer.from_file(PATH)
    offsets = encoder.encode(text, add_special_tokens=False).offsets
    budget = max(1, tokens - len(encoder.encode(header, add_special_tokens=False).ids))
    ends = [text[:e].endswith("\n") or (text[:e][-1:] in (".", "!", "?") and (e == len(text) or text[e].isspace())) for _, e in offsets]
    out, at = [], 0
    while at < len(offsets):
        end = min(at + budget, len(offsets))
        if end < len(offsets):
            fits = [j + 1 for j in range(at, end) if ends[j] and j + 1 >= at + budget * 0.65]
            end = fits[-1] if fits else end
        out.append((at, end - at, offsets[at][0], offsets[end - 1][1]))
        if end == len(offsets):
            break
        at = max(end - overlap, at + 1)
    return out


def test_windows_follow_the_rule(spark):
    draw = random.Random(3)
    words = ["ship", "Öl", "engine.", "日本", "no!", "why?\n", "3.5", "end.", "🎉"]
    rows = [(i, "h " * draw.randrange(12), " ".join(draw.choice(words) for _ in range(draw.randrange(1, 160)))) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "x " * 60, "one two three four. five"), (103, None, "no sentence ends " * 60), (None, "h", "short text."), (104, "h", " ".join(["long."] * 9000)), (7, "h", "same id.")]
    df = spark.createDataFrame(rows, "doc_id bigint, header string, text string")
    got = {}
    for r in windows.token_windows(df, PATH, tokens=40, overlap=6).collect():
        got.setdefault((r["doc_id"], r["chunk_id"]), []).append((r["first_token"], r["n_tokens"], r["at"], r["until"]))
    expected = {}
    for doc, header, text in rows:
        for i, w in enumerate(by_hand(text or "", header or "", 40, 6), 1):
            expected.setdefault((doc, f"{'' if doc is None else doc}__e{i:03d}"), []).append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert windows.token_windows(df.where("false"), PATH).count() == 0
