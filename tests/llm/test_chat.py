from siftwork.llm import bpe, chat, queries
from tools.compare import compare

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
V = bpe.Vocabulary.load()


def checked(spark, data, extra=""):
    """Rebuild every conversation from the trees."""
    df = spark.createDataFrame([(*r, *([0] * len(extra.split(",")) if extra else [])) for r in data], SCHEMA + (", " + extra if extra else ""))
    nodes = chat.trees(df).collect()
    ends = {}
    for m in chat.members(df).collect():
        ends.setdefault(m["node"], []).append(m["conv"])
    by = {n["node"]: n for n in nodes}
    assert len(by) == len(nodes)
    convs = {}
    for c, t, r, x in dict.fromkeys(data):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", chat.bpe and (x or ""), r or ""))
    places = {}
    for n in nodes:
        assert n["end"] - n["begin"] == len(n["tokens"]) == len(n["position_ids"])
        for k in range(n["begin"], n["end"]):
            assert (n["tree_id"], k) not in places
            places[(n["tree_id"], k)] = (n["tokens"][k - n["begin"]], n["position_ids"][k - n["begin"]])
    for tree in {n["tree_id"] for n in nodes}:
        own = sorted(k for t, k in places if t == tree)
        assert own == list(range(len(own)))
    seen = set()
    for n in nodes:
        assert n["n_ending"] == len(ends.get(n["node"], [])) and (n["parent"] is None) == (n["depth"] == 0)
        assert n["n_conversations"] == n["n_ending"] + sum(k["n_conversations"] for k in nodes if k["parent"] == n["node"])
        if n["parent"]:
            assert by[n["parent"]]["depth"] == n["depth"] - 1 and by[n["parent"]]["tree_id"] == n["tree_id"]
        gaps = [(i["end"], j["begin"]) for i, j in zip(n["ancestors"], n["ancestors"][1:])]
        assert all(a < b for a, b in gaps) and all(i["begin"] < i["end"] for i in n["ancestors"])
        for c in ends.get(n["node"], []):
            seen.add(c)
            path = [places[(n["tree_id"], k)] for i in [*n["ancestors"], {"begin": n["begin"], "end": n["end"]}] for k in range(i["begin"], i["end"])]
            assert [p for _, p in path] == list(range(len(path)))
            turns = sorted(convs[c], key=lambda x: (x[0], x[1], x[4]))
            assert bpe.decode(V, [t for t, _ in path]) == "".join(chat.formatted(r, x) for _, _, _, x, r in turns)
    assert seen == set(convs)
    return nodes


DATA = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hello"), (2, 2, "assistant", "hey"),
    (3, 0, "system", "be kind"), (3, 1, "user", "bye"),
    (4, 0, "user", "hello"),
    (5, 0, "system", "be kind"),
    (6, 0, "system", "be kind"), (6, 1, "user", "hello"), (6, 2, "assistant", "hi"),
]


def test_shared_turns_are_written_once(spark):
    nodes = checked(spark, DATA)
    assert len(nodes) == 6 and len({n["tree_id"] for n in nodes}) == 2
    both = next(n for n in nodes if n["n_ending"] == 2)
    assert both["n_conversations"] == 2 and both["depth"] == 2 and len(both["ancestors"]) <= 2
    root = next(n for n in nodes if n["depth"] == 0 and n["n_conversations"] > 1)
    assert root["n_conversations"] == 5 and root["n_ending"] == 1 and root["begin"] == 0


def test_odd_rows(spark):
    long = "words and more " * 30_000
    data = [(1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (2, None, "user", "x"), (None, 0, "user", "lost"), (3, 0, "user", long), (4, 0, "user", long), (4, 0, "assistant", "tie")]
    checked(spark, data)
    a = [tuple(r) for r in checked(spark, data, "id int, tokens int, path int, h int, depth int")]
    assert len(a) == len(checked(spark, data))
    assert chat.trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    checked(spark, data)


def test_wide_and_deep(spark):
    data = [(c, 0, "system", "s") for c in range(300)] + [(c, 1, "user", f"u{c % 50}") for c in range(300)] + [(1000, t, "user", str(t)) for t in range(60)]
    nodes = checked(spark, data)
    assert len(nodes) == 1 + 50 + 60
    assert max(len(n["ancestors"]) for n in nodes) <= 2


def test_one_very_long_conversation(spark):
    """Its nodes attend to one interval each, so the result grows with the turns and not with their square."""
    data = [(1, t, "user", f"{t} {t % 7}") for t in range(2000)] + [(2, t, "user", f"{t} {t % 7}" if t < 1500 else "other") for t in range(1600)]
    nodes = {n["node"]: n for n in chat.trees(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(nodes) == 2000 + 100
    assert max(len(n["ancestors"]) for n in nodes.values()) <= 2
    assert sum(n["end"] - n["begin"] for n in nodes.values()) == max(n["end"] for n in nodes.values())
    last = max(nodes.values(), key=lambda n: n["depth"])
    assert last["position_ids"][-1] + 1 == sum(i["end"] - i["begin"] for i in last["ancestors"]) + last["end"] - last["begin"]


def test_members_match_sql(spark, small):
    said = compare(spark, small, "op8_chat_members", queries.QUERIES["op8_chat_members"], queries.ORACLE_SQL["op8_chat_members"])
    assert said.startswith("ok"), said
