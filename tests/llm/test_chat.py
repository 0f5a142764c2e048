import itertools

import numpy as np

from reedbed.llm import chat
from reedbed.llm.tables import table

SF = "/root/testdata/sf0.01"


def some_model(seed=0):
    rng = np.random.default_rng(seed)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    n = len(chat.STATES)
    return chat.Model(log(n), log(n, n), [log(n, v) for _, v in chat.FEATURES])


def features(n, seed):
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, v, n) for _, v in chat.FEATURES], axis=1)


def test_viterbi_equals_all_paths():
    for seed in range(4):
        model, own = some_model(seed), features(4, seed)
        scores = model.scores(own)

        def value(path, model=model, scores=scores):
            return model.initial[path[0]] + scores[0, path[0]] + sum(model.transition[a, b] + scores[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(path)))

        best = max(itertools.product(range(len(chat.STATES)), repeat=4), key=value)
        assert tuple(model.decode(own)) == best


def test_blocks_equal_one_run():
    model, own = some_model(5), features(500, 5)
    parts = np.array_split(own, 13)
    matrices = np.array([model.matrix(p) for p in parts])
    start = np.where(np.arange(chat.START + 1) == chat.START, 0.0, chat.NEVER)
    end = int((start[:, None] + chat.product(matrices)).max(0).argmax())
    got = np.concatenate([model.decode(p, e, x) for p, (e, _, x) in zip(parts, chat.dealt(matrices, start, end), strict=True)])
    assert (got == model.decode(own)).all()


def trained(spark):
    turn = chat.turns(table(spark, SF, "conversations"))
    return chat.train(chat.known_lines(turn))


def test_long_conversation_equals_one_transcript(spark, monkeypatch):
    monkeypatch.setattr(chat, "PARTS_PER_BLOCK", 2)
    model = trained(spark)
    marks = {"user": "User: ", "assistant": "Assistant: "}
    turns = [("user" if i % 2 == 0 else "assistant", f"{'Why' if i % 2 == 0 else 'Because'} of {i}{'?' if i % 2 == 0 else '.'}\n\nA second line {i}") for i in range(1000)]
    lines = ["\n" + ("" if i % 5 == 3 else marks[r]) + t for i, (r, t) in enumerate(turns)]
    whole = chat.parse(spark.createDataFrame([(1, "\n".join(lines))], "id long, transcript string"), model, ["id"]).first().chat
    # parts are cut within turns too
    cut = "\n".join(lines).split("\n")
    places = [0, *[next(i for i in range(at, 0, -1) if cut[i - 1]) for at in range(301, len(cut), 301)], len(cut)]
    parts = [("c", i, "\n".join(cut[a:z])) for i, (a, z) in enumerate(itertools.pairwise(places))] + [("d", 0, "User: hi\nthere"), ("e", 1, " \n"), ("f", 3, None)]
    got = {(r.key, r.p): r.chat for r in chat.parse_parts(spark.createDataFrame(parts, "key string, p long, transcript string"), model).collect()}
    own = [got["c", i] for i in range(len(parts) - 3)]
    assert [r for c in own for r in c.roles] == whole.roles and len(whole.roles) > 900
    assert "".join(c.rendered for c in own) == whole.rendered
    assert len(got["d", 0].roles) == 1 and got["d", 0].rendered.endswith("hi\nthere\n<|end|>\n") and ("e", 1) not in got


def test_all_lines_come_back(spark):
    model = trained(spark)
    text = "User: What is it?\nA: this line is my own\n\n\nstill mine\nAssistant: It is this.\n\nAnswer: inside\nend"
    c = chat.parse(spark.createDataFrame([(text,)], "transcript string"), model, []).first().chat
    back = [line for line in c.rendered.split("\n") if line and not line.startswith("<|")]
    for line, want in zip(back, [x for x in text.split("\n") if x], strict=True):
        assert want.endswith(line)
    assert "\n\n\nstill mine" in c.rendered or "still mine" not in c.texts[0]


def test_odd_transcripts(spark):
    model = trained(spark)
    rows = [(1, None, "x"), (1, "", "x"), (None, " \n\n", None), (2, "User: a\nAssistant: b", "y"), (2, "User: a\nAssistant: b", "y"), (3, "line\n" * 60_000, "z")]
    got = chat.parse(spark.createDataFrame(rows, "id long, transcript string, chat string"), model, ["id"]).collect()
    assert len(got) == len(rows) and got[3] == got[4] and [r.chat.roles for r in got[:3]] == [[], [], []]
    assert chat.parse(spark.createDataFrame([], "id long, transcript string"), model, ["id"]).count() == 0
    none = chat.train(chat.known_lines(chat.turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))
    assert len(none.decode(features(3, 1))) == 3
    odd = spark.createDataFrame([(1, None, "user", "a"), (1, None, "user", "b"), (1, 0, None, None), (None, 3, "bot", "c"), (-5, -700, "user", "d")], "conv_id long, turn long, role string, text string")
    assert chat.turns(odd).select("key").distinct().count() == 5


def test_held_out_roles(spark):
    got = chat.op2(spark, SF).filter("held_out").toPandas()
    assert (got["roles"] == got["true_roles"]).mean() > 0.9
