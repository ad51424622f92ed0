import random

import hashlib
from itertools import product

from proofmill.llm import chat

TEXTS = ["", None, "</s>[INST] ok [/INST]", "<\\s>[\\\\INST]<<SYS>><\\</SYS>>", "\n</s>\n<s>user\nhi</s>\n", "<", "[", "\\", "[[INST]]", "hé 你好 \U0001f600", "word " * 900]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    pieces = ["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "x"]
    rows = [("".join(p),) for n in (1, 2, 3, 4) for p in product(pieces, repeat=n)]
    df = spark.createDataFrame(rows, "t string").select("t", chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u"), chat.unescape_role(chat.escape_role("t")).alias("r"))
    for r in df.collect():
        assert r["t"] == r["u"] == r["r"]
        assert not any(x in r["e"] for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_windows_read_back_and_learn_each_target_once(spark):
    roles = ["system", "user", "assistant", "user", "assistant", None, "assistant", "odd\n\\role", "user", "assistant", "assistant"]
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate(zip(roles, TEXTS, strict=True))]
    rows += [(2, i, "system" if not i else "assistant" if i % 2 else "user", f"turn {i} " * 20, 0) for i in range(60)]
    rows += [(3, 0, "user", "tie b", 0), (3, 0, "user", "tie a", 0), (3, 0, "user", "tie a", 0), (None, 0, "assistant", "no key", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    out = chat.windows(df, budget=256, history_tokens=64, system_tokens=48)
    kept = out.collect()
    got: dict = {}
    for r in chat.read_back(out).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        back = sorted(got[conv], key=lambda r: r["index"])
        assert [(r[2] or "", r[3] or "") for r in mine] == [(r["role"], r["text"]) for r in back]
        assert [r[3] or "" for r in mine if r[2] == "assistant"] == [r["loss_text"] for r in back if r["loss_text"] is not None]
    two = sorted((r for r in kept if r["conv_id"] == 2), key=lambda r: r["window"])
    assert len(two) > 3 and all(r["formatted"].startswith("<s>system\nturn 0 ") for r in two)
    assert all(not r["over_budget"] for r in two) and any(t["repeated"] and t["index"] for r in two for t in r["turns"])
    assert all(len(r["formatted"][t["start"] : t["start"] + t["length"]]) == t["length"] for r in kept for t in r["turns"])
    assert chat.windows(df.limit(0)).count() == 0 and hashlib


def test_over_budget_only_where_turn_and_system_do_not_fit(spark):
    r = random.Random(4)
    rows = []
    for conv in range(60):
        system = [0, 20, 300, 700, 1100][conv % 5]
        sizes = ([system] if system else []) + [r.choice([5, 60, 200, 380, 390, 700, 760, 1000, 1010, 1100]) for _ in range(40)]
        rows += [(conv, i, "system" if system and not i else "user" if i % 2 else "assistant", "x" * (4 * n - 4 * 5)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = {(c, i): -(-(len(chat.OPEN) + len(role) + 1 + len(text) + len(chat.CLOSE)) // 4) for c, i, role, text in rows}
    own = {}
    for w in chat.windows(df).collect():
        turns = [t["index"] for t in w["turns"]]
        assert w["n_tokens"] == sum(sizes[w["conv_id"], i] for i in turns) and w["over_budget"] == (w["n_tokens"] > 1024)
        kept = [t["index"] for t in w["turns"] if not t["repeated"]]
        own.setdefault(w["conv_id"], []).extend(kept)
        if w["over_budget"]:
            lead = sizes[w["conv_id"], 0] if w["conv_id"] % 5 and kept != [0] else 0
            assert len(kept) == 1 and sizes[w["conv_id"], kept[0]] + lead > 1024 and set(turns) <= {0, *kept}
    assert all(sorted(i) == list(range(len(i))) for i in own.values()) and sum(map(len, own.values())) == len(rows)
