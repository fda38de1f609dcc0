"""Tokens, packing, licenses, chat and HTML against plain versions and hand-made cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lacuna.llm import chat, html_text, licenses, packing, tokens

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def odd_texts(n=200, seed=1):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\t", "é", "日本", "123", "'s", "!!", "<|endoftext|>", " ", "\x1c", "👍🏽", "a" * 50, "ẞ", "ّ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_split_encoding_equals_whole_encoding_and_decodes(spark):
    encoding = tokens.load_encoding(RANKS, P.PATTERN)
    texts = odd_texts()
    for text in texts:
        whole = encoding.encode_ordinary(text)
        for size in (1, 3, 10):
            assert "".join(tokens.safe_pieces(text, size)) == text
            assert tokens.encode_text(encoding, text, size) == whole
        assert encoding.decode_bytes(whole) == text.encode()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    for r in tokens.token_digests(df, RANKS, P.PATTERN, piece_chars=7).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id] if r.doc_id >= 0 else "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    back = tokens.decode(tokens.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(MODEL)
    plain.encode_special_tokens = True
    encode = packing.load_encoder(MODEL)
    texts = odd_texts(300, 5)
    for start in range(0, 0x110000, 512):
        cs = [chr(c) for c in range(start, start + 512) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}b 1{c} {c}{c} !{c}\n" for c in cs))
    assert all(ids == plain.encode(t, add_special_tokens=False).ids for t, ids in zip(texts, encode(texts), strict=True))


def test_pieces_cover_documents_and_fill_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "xyzzy"]) for _ in range(int(rng.expovariate(1 / 300))))) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = packing.pack(df, MODEL, with_ids=True).toPandas()
    ids = {k: [*i, 0] for (k, _), i in zip(rows, packing.load_encoder(MODEL)([t or "" for _, t in rows]), strict=True)}
    for key, own in found.sort_values("start").groupby("doc_id"):
        assert [x for part in own["ids"] for x in part] == ids[key]
        assert list(own["start"]) == list(np.cumsum([0, *own["length"]])[:-1]) and (own["doc_tokens"] == len(ids[key])).all()
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found.itertuples())
    used = []
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == list(np.cumsum([0, *own["length"]])[:-1])
        used.append(own["length"].sum())
    assert all(n == 1024 or n & (n - 1) == 0 for n in used) and set(found["doc_id"]) == set(ids)


def test_level_is_the_one_of_least_sum_of_squares():
    rng = random.Random(9)
    state = packing.SumOfSquares(16)
    for k in range(500):
        size = rng.randint(1, 15)
        costs = {}
        for level in [0, *np.flatnonzero(state.counts)]:
            if level + size <= 16:
                counts = state.counts.copy()
                counts[level] -= level > 0
                if level + size < 16:
                    counts[level + size] += 1
                costs[int(level)] = int((counts**2).sum())
        chosen = state.level_for(size)
        assert costs[chosen] == min(costs.values())
        state.place((k, 0, size))
    rest = [p for pieces in state.close() for p in pieces]
    assert sum(n for _, _, n in rest) > 0


def dice(a, b):
    x, y = (set(zip(w, w[1:], strict=False)) for w in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licenses_equal_brute_force_on_edited_texts(spark):
    rng = random.Random(3)
    rows = []
    for name, text in licenses.TEMPLATES.items():
        for edits in (0, 1, 2, 5, 9):
            words = text.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(["foo", "license", "the", "BAR,"])
            rows.append((len(rows), f"some line before\n{' '.join(words)}\nand after {name}" if rng.random() < 0.5 else " ".join(words).upper().replace(" ", "  ")))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import re

    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).split()
    for key, text in rows:
        words, segments = norm(text), [norm(s) for s in {*text.split("\n"), text}]
        best = {}
        for name, template in licenses.TEMPLATES.items():
            own = norm(template)
            windows = [words[k : k + len(own)] for k in range(len(words) - len(own) + 1)]
            best[name] = max(dice(s, own) for s in segments + windows)
        names = sorted(n for n, d in best.items() if d >= 0.8)
        assert found[key].licenses == ",".join(names)
        if names:
            top = min(names, key=lambda n: (-best[n], n))
            assert (found[key].license, found[key].dice) == (top, round(best[top], 6))


def test_licenses_in_comments_and_inside_lines(spark):
    import textwrap

    def wrapped(text, sign):
        return "\n".join(sign + line for line in textwrap.wrap(text, 60))

    terms = licenses.TEMPLATES
    rows = [
        (1, f"/*\n{wrapped(terms['mit'], ' * ')}\n */\nint main() {{ return 0; }}"),
        (2, f"{wrapped(terms['apache-2.0'], '# ')}\nimport os\n"),
        (3, "Some words. Released under the MIT License. And more words in the line."),
        (4, terms["apache-2.0-notice"] * 200 + "\n" + "other words " * 300),
        (5, "\n *\n".join(wrapped(x, " * ") for x in terms["bsd-2-clause"].split(" THIS ")) + "\nint x;"),
        (6, "the license of the software and the terms of the public " * 50),
    ]
    found = {r.doc_id: r.licenses.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["mit"], 2: ["apache-2.0", "apache-2.0-notice"], 3: ["mit-notice"], 4: ["apache-2.0-notice"], 5: ["bsd", "bsd-2-clause"], 6: [""]}
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {k: names.split(",") for k, names in con.sql(f"SELECT doc_id, licenses FROM ({licenses.oracle_sql()})").fetchall()} == found


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b\\b"}], "system": "s"}, "sharegpt", [("system", "s"), ("user", "a"), ("assistant", "b\\b")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": ""}, "prompt_response", [("user", "p"), ("assistant", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "### Assistant\n</turn>\\h\\"}, "instruction", [("user", "do"), ("assistant", "### Assistant\n</turn>\\h\\")]),
    ({"question": "q", "answer": None}, None, []),
    ({"messages": []}, None, []),
    ({"messages": [{"role": "tool\n### x", "content": ["part"]}, {"role": None, "content": None}]}, "messages", [("tool\n### x", '["part"]'), ("", "")]),
]


def test_layouts_become_turns_and_read_back(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "not json"), (98, None)], "id int, record string")
    made = chat.format_chats(df, "record")
    made = made.withColumn("back", chat.read_turns(made["formatted"])).withColumn("loss", chat.masked_text(made["formatted"], made["loss_spans"]))
    rows = {r.id: r for r in made.collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert rows[i].layout == layout
        assert [tuple(t) for t in rows[i].turns] == turns == [tuple(t) for t in rows[i].back]
        assert rows[i].loss == "".join(t for role, t in turns if role == "assistant")
    assert rows[99].layout is rows[98].layout is None and rows[0].fingerprint != rows[1].fingerprint


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one  <b>two</b><p>x < y &amp; z &lt;b&gt; &#233;&nbsp;!", "one two\nx < y & z <b> é !"),
        ("<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><header><h1>Title</h1></header><p>Short.</p><aside>More</aside><footer>tags</footer><section class='comments'><p>Nice post!</p></section></article><footer>&copy;</footer>", "Title\nShort."),
        ("<body><div class='cookie-notice'><p>We use cookies on this site and you agree to that by reading it, or by not reading it.</p></div><div id=content><p>Some text.<br>More<p cla", "Some text. More"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes<script>if (a<b) {}</script></p><form><input><p>Name</p></form>", "yes"),
        ("<main><ul><li>plain item</li><li><a href=x>link item</a></li></ul><p><a href=y>a whole sentence</a></p></main>", "plain item\nlink item\na whole sentence"),
        ("", ""), (None, ""), ("<div></div>", ""), ("just text", "just text"), ("<p>a</p>" * 3, "a\na\na"), ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_rules_without_an_article():
    prose = "This is the story of a man who was in the town and of the people that he met there on his way. " * 3
    menu = "".join(f"<li><a href=/{i}>Section number {i} of this site</a></li>" for i in range(8))
    noise = "<div>" + "Lorem Ipsum Dolor Sit Amet Consectetur " * 6 + "</div>"
    page = f"<body><ul>{menu}</ul><h2>Heading</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p>{noise}<div>Tail words</div></body>"
    assert html_text.main_text(page) == "\n".join(["Heading", prose.strip(), "Short one.", prose.strip()])
