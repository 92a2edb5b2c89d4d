import time
from dataclasses import replace

import pytest

from mosaiq.plans.document import Document, History, Layer, Mutation, Session, Transform, render, render_key
from mosaiq.plans.graph import in_order
from mosaiq.plans.history import effective, state
from mosaiq.plans.jobs import Jobs

DOC = Document(10, 10, (Layer(1, "a", transforms=(Transform("blur", 2), Transform("exposure", 1))), Layer(2, "b")))
EDITS = [
    Mutation("SetLayerName", 1, "", "sky"),
    Mutation("SetLayerVisible", 2, True, False),
    Mutation("SetLayerOpacity", 1, 1.0, 0.5),
    Mutation("SetLayerBlend", 1, "Normal", "Multiply"),
    Mutation("AddLayer", after=Layer(3, "c"), index=1),
    Mutation("SwapLayers", index=0, after=2),
    Mutation("AddTransform", 1, after=Transform("blur", 9), index=1),
    Mutation("ReorderTransform", 1, index=0, after=2),
    Mutation("UpdateTransformOp", 1, Transform("blur", 9), Transform("blur", 4), index=0),
    Mutation("SetTransformEnabled", 1, True, False, index=1),
    Mutation("RemoveTransform", 1, before=Transform("blur", 4), index=0),
]


def test_undo_reverses_every_edit():
    history, seen = History(DOC), [DOC]
    for edit in EDITS:
        seen.append(history.push(edit))
    removed = Mutation("RemoveLayer", before=history.document.layers[0], index=0)
    seen.append(history.push(removed))
    for want in reversed(seen[:-1]):
        assert history.undo() == want
    assert history.undo() == DOC
    for want in seen[1:]:
        assert history.redo() == want
    history.undo()
    history.push(EDITS[0])
    assert history.redo() == history.document and history.labels()[-1] == "SetLayerName"


def test_unknown_edit():
    with pytest.raises(ValueError):
        Mutation("Nothing", 1).apply(DOC)


def test_render_key_ignores_what_is_not_rendered():
    layer = DOC.layers[0]
    assert render_key(layer) == render_key(replace(layer, name="x", opacity=0.1))
    assert render_key(layer) != render_key(layer, 1)


def test_log_fold(spark):
    log = [(1, 1, "Set", 0, 0.1), (1, 2, "Set", 0, 0.2), (1, 3, "Undo", 0, 0.0), (1, 4, "Undo", 0, 0.0), (1, 5, "Undo", 0, 0.0), (1, 6, "Redo", 0, 0.0), (1, 7, "Set", 0, 0.3), (1, 8, "Redo", 0, 0.0), (2, 9, "Undo", 0, 0.0)]
    df = spark.createDataFrame(log, "doc_id long, seq long, action string, layer_id int, arg double")
    assert sorted(map(tuple, effective(df).collect())) == [(1, 1), (1, 7)]
    assert [(r["arg"], r["seq"]) for r in state(df).collect()] == [(0.3, 7)]


def test_labels_previews_and_text():
    wanted = ["Rename Layer", "Hide Layer", "Set Opacity", "Set Blend Mode", "Add Layer", "Reorder Layers", "Add Transform", "Reorder Filter", "Update Transform", "Disable Filter", "Remove Transform"]
    assert [e.label() for e in EDITS] == wanted
    assert [e.changes_picture() for e in EDITS[:2]] == [False, True]
    assert EDITS[6].preview() == Transform("blur", 9) and EDITS[8].preview() == Transform("blur", 4) and EDITS[1].preview() is None
    layers = [*EDITS, Mutation("AddLayer", after=Layer(9, (0.1, 0.2, 0.3, 1.0), transforms=(Transform("blur", 1, input=2, blend="Screen"),)), index=0)]
    assert [Mutation.from_json(e.to_json()) for e in layers] == layers
    assert (Transform("blur", 3).label(), Transform("blur", 3).subtitle(), Transform("exposure", -0.5).subtitle()) == ("Blur", "radius 3px", "-0.5 stops")


def test_a_preview_is_no_history():
    session = Session(History(DOC))
    session.preview(EDITS[2])
    assert session.shown.layers[0].opacity == 0.5 and session.history.document == DOC and session.revision == 1
    session.preview(EDITS[0])
    assert session.shown.layers[0].opacity == 1.0 and session.shown.layers[0].name == "sky"
    assert session.discard() == DOC
    session.preview(EDITS[2])
    session.commit(EDITS[2])
    assert session.shown.layers[0].opacity == 0.5 and session.draft is None and session.revision == 5
    session.commit(replace(EDITS[0], recordable=False))
    assert session.shown.layers[0].name == "sky" and len(session.history.past) == 1


def test_order_of_work():
    assert in_order("abcd", [("d", "a"), ("c", "a"), ("c", "d")]) == ["b", "c", "d", "a"]
    with pytest.raises(ValueError, match="circle"):
        in_order("ab", [("a", "b"), ("b", "a")])
    with pytest.raises(KeyError):
        in_order("ab", [("a", "x")])


@pytest.fixture(scope="module")
def plain(spark):
    return {name: spark.createDataFrame([(0, x, *(v + x / 10,) * 3, 1.0) for x in range(3)], "y int, x int, r double, g double, b double, a double").cache() for name, v in (("a", 0.1), ("b", 0.5))}


def reds(doc, plain, **more):
    return [round(r.r, 6) for r in render(doc, plain.__getitem__, plain["a"].select("y", "x"), **more).orderBy("x").collect()]


def test_inputs_and_outputs_of_transforms(plain):
    up = lambda **more: Transform("exposure", 1.0, **more)
    doc = lambda *layers: Document(3, 1, layers)
    assert reds(doc(Layer(1, "a"), Layer(2, "b", transforms=(up(input="below"),))), plain) == [0.2, 0.4, 0.6]
    assert reds(doc(Layer(1, "a", transforms=(up(input="below"),))), plain) == [0.2, 0.4, 0.6]
    assert reds(doc(Layer(1, "a", transforms=(up(input=2),)), Layer(2, "b", visible=False, transforms=(up(),))), plain) == [2.0, 2.4, 2.8]
    assert reds(doc(Layer(1, "a", transforms=(up(blend="Normal", opacity=0.5),))), plain) == [0.15, 0.3, 0.45]
    assert reds(doc(Layer(1, "a", transforms=(up(blend="Multiply"),))), plain) == [0.02, 0.08, 0.18]
    assert reds(doc(Layer(1, "a", transforms=(up(blend="Normal", position="behind"),))), plain) == [0.1, 0.2, 0.3]
    assert reds(doc(Layer(1, "a", transforms=(up(input=2),)), Layer(2, "nowhere", visible=False, transforms=(up(),))), plain, upto=0) == [0.1, 0.2, 0.3]
    with pytest.raises(ValueError, match="circle"):
        reds(doc(Layer(1, "a", transforms=(up(input=2),)), Layer(2, "b", transforms=(up(input="below"),))), plain)
    with pytest.raises(KeyError):
        reds(doc(Layer(1, "a", transforms=(up(input=7),))), plain)
    assert render_key(Layer(1, "a", transforms=(up(input=2),))) is None


def wait_for(check, seconds=60):
    end = time.monotonic() + seconds
    while not check() and time.monotonic() < end:
        time.sleep(0.05)
    assert check()


def test_jobs(spark):
    def slow():
        def nap(batches):
            for batch in batches:
                time.sleep(60)
                yield batch

        return spark.range(0, 8, 1, 8).mapInPandas(nap, "id long").count()

    seen = []
    jobs = Jobs(spark, seen.append, every=0.05)
    first = jobs.start(1, slow)
    wait_for(lambda: jobs.progress(first)[1] > 0)
    assert jobs.is_running(1)
    second = jobs.start(1, lambda: spark.range(1000).repartition(3).count())
    wait_for(lambda: second.ended.is_set() and first.ended.is_set())
    assert second.result == 1000 and not jobs.is_running(1)
    wait_for(lambda: {e.kind for e in seen} >= {"cancelled", "done", "progress"})
    jobs.start(2, lambda: 1 / 0)
    wait_for(lambda: any(e.kind == "error" and e.session == 2 and "division" in e.message for e in seen))
    third = jobs.start(3, slow)
    jobs.cancel(3)
    wait_for(third.ended.is_set)
    assert third.result is None
