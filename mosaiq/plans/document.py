"""Layered documents and the plan that renders one: a pure function from a document to a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.color import convert, exposure
from mosaiq.operators.compose import compose
from mosaiq.operators.filters import box_blur

from .graph import in_order

PIXEL = ("y", "x", "r", "g", "b", "a")


@dataclass(frozen=True)
class Transform:
    """An operation on a layer: ("blur", radius) or ("exposure", stops); disabled ones do nothing.

    input is what it reads: "layer" (the layer, or what the transform before made of it), "below" (all visible layers
    beneath, composed; the layer itself where there are none) or another layer's number (that layer, with its
    transforms, visible or not). Without blend the result takes the layer's place; with one it is blended over it
    (position "front") or laid under it ("behind").
    """

    op: str
    amount: float
    enabled: bool = True
    input: str | int = "layer"
    blend: str | None = None
    opacity: float = 1.0
    position: str = "front"

    def label(self) -> str:
        return {"blur": "Blur", "exposure": "Exposure"}[self.op]

    def subtitle(self) -> str:
        return f"radius {self.amount:.0f}px" if self.op == "blur" else f"{self.amount:+.1f} stops"


@dataclass(frozen=True)
class Layer:
    """A raster by name, or a solid colour, with its place in the stack given by the document's order."""

    layer_id: int
    source: str | tuple[float, float, float, float]
    name: str = ""
    visible: bool = True
    blend: str = "Normal"
    opacity: float = 1.0
    transforms: tuple[Transform, ...] = ()


@dataclass(frozen=True)
class Document:
    """Layers from the bottom up, in a working colour space."""

    width: int
    height: int
    layers: tuple[Layer, ...] = ()
    space: str = "linear_srgb"

    def find(self, layer_id: int) -> int:
        for i, layer in enumerate(self.layers):
            if layer.layer_id == layer_id:
                return i
        raise KeyError(layer_id)


@dataclass(frozen=True)
class Mutation:
    """One edit, with all that undoing it needs."""

    kind: str
    layer_id: int | None = None
    before: object = None
    after: object = None
    index: int | None = None
    recordable: bool = True

    # What edits are called where they are listed.
    LABELS = {
        "SetLayerName": "Rename Layer",
        "SetLayerOpacity": "Set Opacity",
        "SetLayerBlend": "Set Blend Mode",
        "AddLayer": "Add Layer",
        "RemoveLayer": "Remove Layer",
        "SwapLayers": "Reorder Layers",
        "AddTransform": "Add Transform",
        "RemoveTransform": "Remove Transform",
        "UpdateTransformOp": "Update Transform",
        "ReorderTransform": "Reorder Filter",
    }
    FIELDS = {"SetLayerName": "name", "SetLayerVisible": "visible", "SetLayerOpacity": "opacity", "SetLayerBlend": "blend"}

    def label(self) -> str:
        if self.kind == "SetLayerVisible":
            return "Show Layer" if self.after else "Hide Layer"
        if self.kind == "SetTransformEnabled":
            return "Enable Filter" if self.after else "Disable Filter"
        return self.LABELS[self.kind]

    def preview(self) -> Transform | None:
        """The operation that a live preview of the edit shows, if there is one."""
        return self.after if self.kind in ("AddTransform", "UpdateTransformOp") else None

    def changes_picture(self) -> bool:
        return self.kind != "SetLayerName"

    def to_json(self) -> str:
        pack = lambda v: {"layer": asdict(v)} if isinstance(v, Layer) else {"transform": asdict(v)} if isinstance(v, Transform) else {"value": v}
        return json.dumps({"type": self.kind, "layer_id": self.layer_id, "before": pack(self.before), "after": pack(self.after), "index": self.index, "recordable": self.recordable})

    @classmethod
    def from_json(cls, text: str) -> Mutation:
        def unpack(cell: dict) -> object:
            if "layer" in cell:
                given = cell["layer"]
                source = tuple(given["source"]) if isinstance(given["source"], list) else given["source"]
                return Layer(**given | {"source": source, "transforms": tuple(Transform(**t) for t in given["transforms"])})
            return Transform(**cell["transform"]) if "transform" in cell else cell["value"]

        row = json.loads(text)
        return cls(row["type"], row["layer_id"], unpack(row["before"]), unpack(row["after"]), row["index"], row["recordable"])

    def apply(self, doc: Document, undo: bool = False) -> Document:
        layers = list(doc.layers)
        value = self.before if undo else self.after
        if self.kind in self.FIELDS:
            i = doc.find(self.layer_id)
            layers[i] = replace(layers[i], **{self.FIELDS[self.kind]: value})
        elif self.kind in ("AddLayer", "RemoveLayer"):
            if (self.kind == "AddLayer") != undo:
                layers.insert(self.index, self.after if self.kind == "AddLayer" else self.before)
            else:
                layers.pop(self.index)
        elif self.kind == "SwapLayers":
            a, b = self.index, self.after
            layers[a], layers[b] = layers[b], layers[a]
        else:
            i = doc.find(self.layer_id)
            transforms = list(layers[i].transforms)
            if self.kind in ("AddTransform", "RemoveTransform"):
                if (self.kind == "AddTransform") != undo:
                    transforms.insert(self.index, self.after if self.kind == "AddTransform" else self.before)
                else:
                    transforms.pop(self.index)
            elif self.kind == "UpdateTransformOp":
                transforms[self.index] = value
            elif self.kind == "SetTransformEnabled":
                transforms[self.index] = replace(transforms[self.index], enabled=value)
            elif self.kind == "ReorderTransform":
                a, b = (self.after, self.index) if undo else (self.index, self.after)
                transforms.insert(b, transforms.pop(a))
            else:
                raise ValueError(f"unknown edit {self.kind}")
            layers[i] = replace(layers[i], transforms=tuple(transforms))
        return replace(doc, layers=tuple(layers))


@dataclass
class History:
    """Edits done, with a cursor; a new edit cuts off those undone."""

    document: Document
    past: list[Mutation] = field(default_factory=list)
    cursor: int = 0

    def push(self, edit: Mutation) -> Document:
        self.document = edit.apply(self.document)
        self.past[self.cursor :] = [edit]
        self.cursor += 1
        return self.document

    def undo(self) -> Document:
        if self.cursor:
            self.cursor -= 1
            self.document = self.past[self.cursor].apply(self.document, undo=True)
        return self.document

    def redo(self) -> Document:
        if self.cursor < len(self.past):
            self.document = self.past[self.cursor].apply(self.document)
            self.cursor += 1
        return self.document

    def labels(self) -> list[str]:
        return [m.kind for m in self.past[: self.cursor]]


@dataclass
class Session:
    """A document under edit. A preview is seen until the next preview, commit or discard, and never part of the history."""

    history: History
    draft: Document | None = None
    revision: int = 0

    @property
    def shown(self) -> Document:
        return self.draft or self.history.document

    def preview(self, edit: Mutation) -> Document:
        self.draft = edit.apply(self.history.document)
        self.revision += 1
        return self.draft

    def discard(self) -> Document:
        self.draft = None
        self.revision += 1
        return self.shown

    def commit(self, edit: Mutation) -> Document:
        """Apply the edit, to be undone later if it is recordable."""
        self.draft = None
        self.revision += 1
        if edit.recordable:
            return self.history.push(edit)
        self.history.document = edit.apply(self.history.document)
        return self.shown


def render_key(layer: Layer, upto: int | None = None) -> str | None:
    """A key of what a prefix of a layer's transforms makes, for a store of rendered rasters; none if it takes more than the layer."""
    if any(t.enabled and t.input != "layer" for t in layer.transforms[:upto]):
        return None
    chosen = asdict(layer) | {"transforms": [asdict(t) for t in layer.transforms[:upto] if t.enabled]}
    for name in ("name", "visible", "blend", "opacity"):
        chosen.pop(name)
    return sha256(json.dumps(chosen, sort_keys=True).encode()).hexdigest()


def solid(like: DataFrame, colour: tuple[float, float, float, float]) -> DataFrame:
    """A layer of one colour at the places of another raster."""
    return like.select("y", "x", *(F.lit(float(v)).alias(c) for v, c in zip(colour, "rgba", strict=True)))


def render(doc: Document, rasters: Callable[[str], DataFrame], canvas: DataFrame, target: str | None = None, mip: int = 0, upto: int | None = None) -> DataFrame:
    """The visible layers composed; nothing runs until an action does.

    rasters gives a named source as pixels in the document's space; canvas is a grid (y, x) for
    solid colours and for a document without visible layers, which is transparent. upto takes
    that many transforms of each layer only. Layers that take one another as input, in a circle, are refused.
    """
    visible = [layer for layer in doc.layers if layer.visible]
    if not visible:
        return solid(canvas, (0, 0, 0, 0))
    under = {layer.layer_id: [v for v in doc.layers[:i] if v.visible] for i, layer in enumerate(doc.layers)}
    inputs = {x.layer_id: {t.input for t in x.transforms[:upto] if t.enabled} for x in doc.layers}
    edges = [(other, x) for x, needed in inputs.items() for i in needed for other in ([v.layer_id for v in under[x]] if i == "below" else [] if i == "layer" else [i])]
    order = in_order([x.layer_id for x in doc.layers], edges)
    wanted = {x.layer_id for x in visible}
    for layer_id in reversed(order):
        wanted |= {a for a, b in edges if b == layer_id and layer_id in wanted}
    drawn: dict[int, DataFrame] = {}

    def together(layers: list[Layer]) -> DataFrame:
        made = [drawn[x.layer_id] for x in layers]
        return made[0] if len(made) == 1 else compose(made, [x.blend for x in layers], [x.opacity for x in layers])

    def operate(t: Transform, px: DataFrame) -> DataFrame:
        if t.op == "blur":
            return box_blur(px, int(t.amount), mip=mip)
        if t.op == "exposure":
            return px.withColumns({c: exposure(F.col(c), t.amount) for c in "rgb"})
        raise ValueError(f"unknown operation {t.op}")

    for layer_id in filter(wanted.__contains__, order):
        layer = doc.layers[doc.find(layer_id)]
        px = rasters(layer.source) if isinstance(layer.source, str) else solid(canvas, layer.source)
        for t in layer.transforms[:upto]:
            if not t.enabled:
                continue
            taken = px if t.input == "layer" or (t.input == "below" and not under[layer_id]) else together(under[layer_id]) if t.input == "below" else drawn[t.input]
            made = operate(t, taken)
            if t.blend is None:
                px = made
            elif t.position == "behind":
                px = compose([made.withColumn("a", F.col("a") * t.opacity).select(*PIXEL), px.select(*PIXEL)], ["Normal", "Normal"], [1.0, 1.0])
            else:
                px = compose([px.select(*PIXEL), made.select(*PIXEL)], ["Normal", t.blend], [1.0, t.opacity])
        drawn[layer_id] = px.select(*PIXEL)
    out = together(visible)
    return convert(out, doc.space, target) if target else out
