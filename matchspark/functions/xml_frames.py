"""Frames of tracker XML out of Arrow batches of text: plain ones by columns, all others by an XML parser."""
from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OF_FRAME, OF_OBJECT, KINDS = ("eventPeriod", "matchTime", "ballStatus"), ("playerId", "speed", "loc"), ("player", "ball")
FRAMES = "match_id string, period string, ms string, ball_status string"
OBJECTS = FRAMES + ", ball boolean, number int, id string, speed string, x double, y double, loc string"
_FRAME = [(n, pa.string()) for n in ("match_id", "period", "ms", "ball_status")]
_OBJECT = [("ball", pa.bool_()), ("number", pa.int32()), ("id", pa.string()), ("speed", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("loc", pa.string())]
RECORDS = 2000      # fixed value: frames handled at once, a few MB of text

_ATTRS = OF_FRAME + OF_OBJECT
_NAME = re.compile(r"(player|ball|)\s+([A-Za-z_][\w.:-]*)\s*=\s*")
_END, _CLOSE = re.compile(r"\s*(/?)>\s*"), re.compile(r"/frame\s*>")
_STARTS = re.compile(r"\s+[^\s<]|[/>]")
_NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
_SHUT = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?]]>", re.S)
FRAME, PLAYER, BALL, CLOSE = range(4)


def _meaning(s: str) -> tuple[int, int, int]:
    """What a text outside quotes is: kind of element, attribute named (6: another), how its tag ends (1: open, 2: closed); -1, -1, 0 if none."""
    if _CLOSE.match(s):
        return CLOSE, -1, 0
    if m := _NAME.fullmatch(s):
        return ("", *KINDS).index(m[1]), _ATTRS.index(m[2]) if m[2] in _ATTRS else len(_ATTRS), 0
    m = _END.fullmatch(s)
    return -1, -1, (2 if m[1] else 1) if m else 0


def _numbers(texts: pa.Array) -> pa.Array:
    t = pc.ascii_trim(texts, "[] \t\r\n")
    try:
        return t.cast(pa.float64())
    except pa.ArrowInvalid:
        return pc.if_else(pc.match_substring_regex(t, _NUMBER), t, None).cast(pa.float64())


def _ids(ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Plain integers, and the text of the others."""
    n = pc.if_else(pc.match_substring_regex(ids, "^[0-9]{1,9}$"), ids, None).cast(pa.int32())
    return n, pc.if_else(n.is_valid(), None, ids)


def _places(loc: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The two numbers of each place, and the text of those that are not two plain numbers."""
    p = pc.split_pattern(loc, ",")
    parts, start, n = p.flatten(), p.offsets.to_numpy()[:-1], np.diff(p.offsets.to_numpy())
    x, y = (_numbers(parts.take(pa.array(start + k, mask=n <= k))) for k in (0, 1))
    return x, y, pc.if_else(pc.and_(x.is_valid(), y.is_valid()), None, loc)


def plain_frames(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array], np.ndarray, list[pa.Array]]:
    """Which records are plain frames, their attributes, and their objects: the frame of each, its attributes.

    Plain: double quotes only, no entities, comments or line ends in values, players and balls as empty elements. The text is cut at < and
    at quotes; the few distinct texts between values are looked at once each."""
    p = pc.split_pattern(texts, "<")
    q = pc.split_pattern(p.flatten(), '"')
    parts, po, qo = q.flatten(), p.offsets.to_numpy(), q.offsets.to_numpy()
    n = np.diff(qo)
    piece = np.repeat(np.arange(len(n)), n)
    odd = (np.arange(len(parts)) - qo[piece]) % 2 == 1
    at, piece = np.flatnonzero(~odd), piece[~odd]
    d = parts.filter(pa.array(~odd)).dictionary_encode()
    kind, attr, end = np.array([_meaning(s) for s in d.dictionary.to_pylist()]).T[:, d.indices.to_numpy()]

    first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    last = np.append(first[1:], len(piece)) - 1
    fine = (attr >= 0) & (kind == FRAME)
    fine[first] = attr[first] >= 0
    fine[last] = end[last] > 0
    good = np.logical_and.reduceat(fine, first) & (n % 2 == 1)
    broken = pc.match_substring_regex(parts.filter(pa.array(odd)), r"[\t\r\n&]").to_numpy(zero_copy_only=False)
    good[np.repeat(np.arange(len(n)), n // 2)[broken]] = False
    known = (attr >= 0) & (attr < len(_ATTRS))
    seen = np.bincount(piece[known] * len(_ATTRS) + attr[known], minlength=len(n) * len(_ATTRS))
    good &= seen.reshape(-1, len(_ATTRS)).max(1) < 2        # an attribute twice is malformed
    kind, end = kind[first], end[last]

    record, number = np.repeat(np.arange(len(texts)), np.diff(po)), np.arange(len(n))
    stop = np.minimum.reduceat(np.where(kind == CLOSE, number, len(n)), po[:-1])
    head = number == po[record]
    inside = ~head & (number < stop[record])
    good &= np.where(head, (kind == FRAME) & (end == 1), ((kind == PLAYER) | (kind == BALL)) & (end == 2))
    ok = (stop < len(n)) & (np.bincount(record[(head | inside) & ~good], minlength=len(texts)) == 0)

    def values(of: np.ndarray, names) -> list[pa.Array]:
        row, out = np.cumsum(of) - 1, []
        for a in names:
            sel = (attr == _ATTRS.index(a)) & of[piece]
            take = np.full(of.sum(), -1)
            take[row[piece[sel]]] = at[sel] + 1
            out.append(parts.take(pa.array(take, mask=take < 0)))
        return out
    frames, objects = values(head & ok[record], OF_FRAME), inside & ok[record]
    pid, speed, loc = values(objects, OF_OBJECT)
    return ok, frames, (np.cumsum(ok) - 1)[record[objects]], [pa.array(kind[objects] == BALL), *_ids(pid), speed, *_places(loc)]


def parsed_frame(text: str) -> tuple | None:
    """Attributes and objects of the frame that starts the text, in whatever XML; nulls if it is malformed, None if it is no frame."""
    if not _STARTS.match(text):
        return None
    depth, frame, objects = 0, None, []

    def start(tag, attrs):
        nonlocal depth, frame
        depth += 1
        if depth == 1:
            frame = attrs
        elif depth == 2 and tag in KINDS:
            objects.append(dict(zip(("ball", "id", "speed", "loc"), (tag == "ball", *map(attrs.get, OF_OBJECT)))))

    def stop(_):
        nonlocal depth
        depth -= 1
    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler = start, stop
    try:
        p.Parse("<frame" + text, True)
    except expat.ExpatError:
        if frame is None or depth:
            return None, None, None, []
    return *map(frame.get, OF_FRAME), objects


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in which no record ends inside a comment or a CDATA section: such a record goes on in the next one."""
    cut = lambda s: "<!" in s and "<!" in re.sub(r"<!(?!--|\[CDATA\[)", "", _SHUT.sub("", s))
    held: tuple[str, str] | None = None
    for b in batches:
        for i in range(0, b.num_rows, RECORDS):
            part = b.slice(i, RECORDS)
            if held is None and not pc.any(pc.match_substring(part["value"], "<!")).as_py():
                yield part
                continue
            out = []
            for m, s in zip(part["match_id"].to_pylist(), part["value"].to_pylist()):
                if held is not None and held[0] == m:
                    s = held[1] + "<frame" + s
                elif held is not None:
                    out.append(held)
                held = (m, s) if cut(s) else None
                if held is None:
                    out.append((m, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["match_id", "value"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in held], ["match_id", "value"])


def _tables(b: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray, list[pa.Array]]]:
    """Columns of frames, the frame of each object, columns of objects."""
    ok, frames, of, objects = plain_frames(b["value"])
    yield [b["match_id"].filter(pa.array(ok)), *frames], of, objects
    rest = b.filter(pa.array(~ok))
    rows = [(m, *f) for m, s in zip(rest["match_id"].to_pylist(), rest["value"].to_pylist()) if (f := parsed_frame(s))]
    if rows:
        *frames, objects = zip(*rows)
        columns = [pa.array([o.get(n) for f in objects for o in f], t) for n, t in _OBJECT]
        yield [pa.array(c, pa.string()) for c in frames], np.repeat(np.arange(len(rows)), [len(f) for f in objects]), columns


def read_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per frame out of records (match_id, value), each the text from behind one <frame to the next."""
    for b in _whole(batches):
        for frames, _, _ in _tables(b):
            yield pa.RecordBatch.from_arrays(frames, schema=pa.schema(_FRAME))


def read_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per object of a frame, out of the same records."""
    for b in _whole(batches):
        for frames, of, objects in _tables(b):
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in frames), *objects], schema=pa.schema(_FRAME + _OBJECT))
