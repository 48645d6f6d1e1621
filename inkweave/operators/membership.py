"""Who is in the mesh: membership updates folded per observer and peer, in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import ROWS_PER_SLICE, cut_lineage, running_sum, with_slices

# Updates of a key that one task folds at once, and slices of a key that are gone through in one value.
UPDATES_PER_SLICE = 100_000
PARTS_PER_GROUP = 20_000

KEYS = ["observer", "peer_id"]
STATE_FIELDS = ["state", "m_incarnation", "m_address", "m_via"]
STATE_SCHEMA = "state string, m_incarnation long, m_address string, m_via string"
FOLD_SCHEMA = f"observer string, peer_id string, _slice long, seq long, type string, changed boolean, is_new boolean, {STATE_SCHEMA}"
NOTHING = (None, None, None, None)


def advance(member: tuple, kind: str, incarnation, address, via) -> tuple[tuple, bool]:
    """The entry (state, incarnation, address, via) after one update, and whether it changed.

    Removed entries ignore ``alive`` but not ``dead``; a higher incarnation replaces all; the
    same one revives and fills in a missing address.  Updates of other kinds change nothing.
    """
    state, known, known_address, known_via = member
    if state is None:
        return (("Alive", incarnation, address, via), True) if kind == "alive" else (member, False)
    if kind == "removed":
        return (("Removed", known, known_address, known_via), True) if state != "Removed" else (member, False)
    if incarnation < known:
        return member, False
    if kind == "dead":
        return (("Dead", incarnation, known_address, known_via), True) if state != "Dead" else (member, False)
    if kind == "suspect":
        return (("Suspected", incarnation, known_address, known_via), True) if state == "Alive" else (member, False)
    if state == "Removed" or kind != "alive":
        return member, False
    if incarnation > known:
        return ("Alive", incarnation, address, via if via is not None else known_via), True
    filled = known_address if known_address is not None else address
    if state == "Alive" and filled == known_address:
        return member, False
    return ("Alive", known, filled, via if via is not None else known_via), True


def _plain(value):
    return None if value is None or value != value else value


def fold_rows(rows: pd.DataFrame, member: tuple) -> Iterator[tuple]:
    """(seq, type, changed, is_new, state...) after each row, in ``seq`` order."""
    ordered = rows.sort_values("seq")
    for seq, kind, inc, address, via in zip(
        ordered["seq"], ordered["type"], ordered["incarnation"], ordered["address"], ordered["via"], strict=True
    ):
        inc = _plain(inc)
        member, changed = advance(member, kind, None if inc is None else int(inc), _plain(address), _plain(via))
        yield (seq, kind, changed, changed and kind == "alive", *member)


# ---- The fold in SQL.
#
# An entry is (state, k, address, via) with a state number (0 unknown, then STATES).  What a number of
# updates do to *any* entry is a list of pieces: entries of class ``cls`` (state number, and whether the
# entry has an address) with ``lo < k <= hi`` get ``state``, ``k`` (null: their own), ``address`` where
# ``put`` is set (else their own) and ``via`` (null: their own).  Such lists can be composed, so any stretch
# of a log has one, whatever holds before it.

STATES = ["Alive", "Suspected", "Dead", "Removed"]
LOW, HIGH = -(2**63) + 1, 2**63 - 1
ENTRY = "struct<state:int,k:bigint,address:string,via:string>"
PIECE = "struct<cls:int,lo:bigint,hi:bigint,state:int,k:bigint,put:boolean,address:string,via:string,changed:boolean>"
UNKNOWN = f"cast(struct(0, 0L, null, null) as {ENTRY})"
KNOWN = "array(2, 3, 4, 5, 6, 7, 8, 9)"
SLICE = [*KEYS, "_slice"]
UPDATE = ["seq", "type", "incarnation", "address", "via"]
# Stands for the address an entry has, whatever it is.
OWN = "\0own"
PIECE_FIELDS = [tuple(f.split(":")) for f in PIECE.removeprefix("struct<").removesuffix(">").split(",")]
STRUCT_NAMES = ["cls", "lo", "hi", "state", "k", "put", "address", "via", "changed"]


def _named(names: list[str], values: list[str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, values, strict=True)) + ")"


def _piece(
    cls: str, state: str, lo: str = f"{LOW}L", hi: str = f"{HIGH}L", k: str = "null", put: str = "false",
    address: str = "null", via: str = "null", changed: str = "true",
) -> str:
    types = ["int", "bigint", "bigint", "int", "bigint", "boolean", "string", "string", "boolean"]
    values = [cls, lo, hi, state, k, put, address, via, changed]
    return _named(STRUCT_NAMES, [f"cast({v} as {t})" for v, t in zip(values, types, strict=True)])


def _same(cls: str, lo: str = f"{LOW}L") -> str:
    return _piece(cls, f"{cls} div 2", lo, changed="false")


def _update(u: str) -> str:
    """The pieces of one update ``u`` (type, incarnation, address, via)."""
    inc = f"{u}.incarnation"
    new = {"k": inc, "put": "true", "address": f"{u}.address", "via": f"{u}.via"}

    def split(classes: str, state: str) -> str:
        """Entries of ``classes`` with an incarnation up to the update's go to ``state``, others stay."""
        return f"flatten(transform(array({classes}), c -> array({_piece('c', state, hi=inc, k=inc)}, {_same('c', inc)})))"

    def stay(classes: str) -> str:
        return f"transform(array({classes}), c -> {_same('c')})"

    # At the same incarnation ``alive`` revives and fills in a missing address, and leaves alone who has both.
    below = f"greatest({inc}, {LOW + 1}L) - 1L"
    level = f"""case when c = 3 or (c = 2 and {u}.address is null) then {_piece('c', 'c div 2', below, inc, changed='false')}
      when c % 2 = 1 then {_piece('c', '1', below, inc, inc, via=f'{u}.via')} else {_piece('c', '1', below, inc, **new)} end"""
    alive = f"""concat(array({_piece('0', '1', **new)}), {stay('8, 9')}, flatten(transform(array(2, 3, 4, 5, 6, 7),
      c -> array({_piece('c', '1', hi=below, **new)}, {level}, {_same('c', inc)}))))"""
    return f"""case {u}.type when 'alive' then {alive}
      when 'suspect' then concat({stay('0, 4, 5, 6, 7, 8, 9')}, {split('2, 3', '2')})
      when 'dead' then concat({stay('0, 6, 7')}, {split('2, 3, 4, 5, 8, 9', '3')})
      when 'removed' then concat({stay('0, 8, 9')}, transform(array(2, 3, 4, 5, 6, 7), c -> {_piece('c', '4')}))
      else {stay('0, 2, 3, 4, 5, 6, 7, 8, 9')} end"""


def _after(pieces: str, entry: str) -> str:
    """The entry after ``pieces``, with ``changed``."""
    cls = f"if({entry}.state = 0, 0, {entry}.state * 2 + cast({entry}.address is not null as int))"
    values = ["q.state", f"coalesce(q.k, {entry}.k)", f"if(q.put, q.address, {entry}.address)", f"coalesce(q.via, {entry}.via)", "q.changed"]
    return f"""transform(filter({pieces}, q -> q.cls = {cls} and {entry}.k > q.lo and {entry}.k <= q.hi),
      q -> {_named(['state', 'k', 'address', 'via', 'changed'], values)})[0]"""


def _composed(first: str, then: str) -> str:
    """The pieces of ``first`` followed by ``then``."""
    cls = "if(p.state = 0, 0, p.state * 2 + if(p.put, cast(p.address is not null as int), p.cls % 2))"
    values = [
        "p.cls", "if(p.k is null, greatest(p.lo, q.lo), p.lo)", "if(p.k is null, least(p.hi, q.hi), p.hi)", "q.state",
        "coalesce(q.k, p.k)", "p.put or q.put", "if(q.put, q.address, p.address)", "coalesce(q.via, p.via)", "p.changed or q.changed",
    ]
    meet = "if(p.k is null, q.lo < p.hi and q.hi > p.lo, p.k > q.lo and p.k <= q.hi)"
    return f"flatten(transform({first}, p -> transform(filter({then}, q -> q.cls = {cls} and {meet}), q -> {_named(STRUCT_NAMES, values)})))"


def _merged(pieces: str) -> str:
    """Neighbouring pieces with one outcome as one piece."""
    last = "element_at(a, -1)"
    outcome = "struct({0}.state, {0}.k, {0}.put, {0}.address, {0}.via, {0}.changed)"
    joined = f"{last}.cls = p.cls and {last}.hi = p.lo and {outcome.format(last)} <=> {outcome.format('p')}"
    longer = _named(STRUCT_NAMES, [f"p.{n}" if n != "lo" else f"{last}.lo" for n in STRUCT_NAMES])
    return f"""aggregate(array_sort({pieces}), cast(array() as array<{PIECE}>), (a, p) -> case when size(a) > 0 and {joined}
      then concat(slice(a, 1, size(a) - 1), array({longer})) else concat(a, array(p)) end)"""


NO_UPDATE = f"concat(array({_same('0')}), transform({KNOWN}, c -> {_same('c')}))"


def _updates(rows: pa.Table) -> Iterator[tuple]:
    """(seq, type, incarnation, address, via) of a slice in order, nulls first."""
    order = [(c, "ascending") for c in UPDATE]
    ordered = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
    return zip(*(ordered.column(c).to_pylist() for c in UPDATE), strict=True)


def stretch(updates: Iterable[tuple]) -> list[tuple]:
    """The pieces of :data:`PIECE` that say what ``updates``, in order, do to any entry.

    Outcomes are kept once each, with the ranges of (class, incarnation) that lead there; entries that meet in
    one outcome stay together, so there are few of them however long the stretch is.
    """
    # (state, k, put, address, via, changed) -> ranges; k is None while entries have their own.
    outcomes: dict[tuple, list[tuple[int, int, int]]] = {}
    for cls in (0, 2, 3, 4, 5, 6, 7, 8, 9):
        # The class is part of the outcome as long as the entry's own address is.
        outcomes[cls // 2, None, cls % 2, False, None, None, False] = [(cls, LOW, HIGH)]
    for _, kind, inc, address, via in updates:
        after: dict[tuple, list[tuple[int, int, int]]] = {}
        for outcome, ranges in outcomes.items():
            state, k, _, *_ = outcome
            if state == 0 or k is not None:
                after.setdefault(_outcome_after(outcome, k, kind, inc, address, via), []).extend(ranges)
                continue
            # Entries with an incarnation of their own part at the update's.
            for low, high, at in ((LOW, inc - 1, inc - 1), (inc - 1, inc, inc), (inc, HIGH, inc + 1)):
                own = [(c, max(lo, low), min(hi, high)) for c, lo, hi in ranges if max(lo, low) < min(hi, high)]
                if own:
                    after.setdefault(_outcome_after(outcome, at, kind, inc, address, via), []).extend(own)
        outcomes = {outcome: _joined(ranges) if len(ranges) > 8 else ranges for outcome, ranges in after.items()}
    return [
        (cls, lo, hi, state, k, put, address, via, changed)
        for (state, k, _, put, address, via, changed), ranges in outcomes.items()
        for cls, lo, hi in _joined(ranges)
    ]


def _outcome_after(outcome: tuple, at: int | None, kind, inc, address, via) -> tuple:
    """An outcome of :func:`stretch` after one more update; ``at`` stands for the incarnation of the entry."""
    state, k, own, put, known_address, known_via, _ = outcome
    # An address of the entry itself is only known to be there or not.
    there = known_address if put else OWN if own else None
    member = (STATES[state - 1], at, there, known_via) if state else NOTHING
    (new_state, new_k, new_address, new_via), did = advance(member, kind, inc, address, via)
    if not did:
        return outcome
    number = STATES.index(new_state) + 1
    # A removal leaves the incarnation alone, and so the entry's own.
    new_k = k if kind == "removed" else new_k
    if new_address is OWN:
        return (number, new_k, own, False, None, new_via, True)
    # What happens at the entry's own lack of an address is the same for all such entries.
    put = put or state == 0 or kind == "alive"
    return (number, new_k, 0 if put else own, put, new_address if put else None, new_via, True)


def _joined(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ranges of one class that touch, as one."""
    out: list[tuple[int, int, int]] = []
    for cls, lo, hi in sorted(ranges):
        if out and out[-1][0] == cls and out[-1][2] == lo:
            out[-1] = (cls, out[-1][1], hi)
        else:
            out.append((cls, lo, hi))
    return out


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _sliced(gossip: DataFrame, rows_per_slice: int) -> DataFrame:
    """Updates with ``_slice``: at most ``rows_per_slice`` of a key in ``seq`` order."""
    return cut_lineage(with_slices(_foreign(gossip), KEYS, "seq", rows_per_slice), "slices")


def _summaries(sliced: DataFrame) -> DataFrame:
    """(key, _slice, pieces) of each slice."""

    def run(rows: pa.Table) -> pa.Table:
        pieces = [dict(zip(STRUCT_NAMES, p, strict=True)) for p in stretch(_updates(rows))]
        return rows.select(SLICE).slice(0, 1).append_column("pieces", pa.array([pieces], pa.list_(piece)))

    piece = pa.struct(
        [(n, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in PIECE_FIELDS]
    )
    return sliced.groupBy(*SLICE).applyInArrow(run, f"{_types(sliced, SLICE)}, pieces array<{PIECE}>")


def _starts(parts: DataFrame, parts_per_group: int) -> DataFrame:
    """(key, _slice, start): the entry before each part of the keys that have several; ``parts`` has ``pieces``.

    Up to ``parts_per_group`` parts of a key are gone through in order; more of them are grouped by rank, the
    groups are composed, and what holds before a group tells what holds before its parts.
    """
    several = cut_lineage(
        parts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "several"
    )
    most = several.agg(F.max("_n")).first()[0]
    known = F.expr(UNKNOWN).alias("start")
    if not most:
        return parts.select(*KEYS, "_slice", known).limit(0)
    rest = parts.join(several.select(*KEYS), KEYS, "left_semi").withColumnRenamed("_slice", "part")
    if most <= parts_per_group:
        groups = rest.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("part", "pieces"))).alias("parts"))
        groups = groups.withColumn("start", known)
    else:
        placed = with_slices(rest, KEYS, "part", parts_per_group)
        groups = cut_lineage(
            placed.groupBy(*KEYS, "_slice").agg(F.array_sort(F.collect_list(F.struct("part", "pieces"))).alias("parts")), "groups"
        )
        whole = f"aggregate(parts, {NO_UPDATE}, (f, g) -> {_merged(_composed('f', 'g.pieces'))})"
        composed = cut_lineage(groups.select(*KEYS, "_slice", F.expr(whole).alias("pieces")), "composed")
        # Ranges of the order may cut a key more often than the ranks do.
        narrowed = composed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        before = _starts(composed, parts_per_group if narrowed < most else narrowed)
        groups = groups.join(before, [*KEYS, "_slice"], "left").withColumn("start", F.coalesce("start", F.expr(UNKNOWN)))
    entry = f"transform(array({_after('g.pieces', 'a.now')}), r -> cast(struct(r.state, r.k, r.address, r.via) as {ENTRY}))[0]"
    step = f"(a, g) -> named_struct('now', {entry}, 'all', concat(a.all, array(named_struct('part', g.part, 'start', a.now))))"
    none = f"cast(array() as array<struct<part:bigint,start:{ENTRY}>>)"
    starts = F.expr(f"aggregate(parts, named_struct('now', start, 'all', {none}), {step}).all")
    return cut_lineage(
        groups.select(*KEYS, F.explode(starts).alias("s")).select(*KEYS, F.col("s.part").alias("_slice"), "s.start"), "starts"
    )


def _with_starts(gossip: DataFrame, rows_per_slice: int, parts_per_group: int) -> DataFrame:
    """Updates with their slice and the entry that holds before it; a key in one slice starts with nothing."""
    sliced = _sliced(gossip, rows_per_slice)
    slices = sliced.select(*KEYS, "_slice").distinct()
    several = slices.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = _summaries(sliced.join(several.select(*KEYS), KEYS, "left_semi"))
    starts = _starts(cut_lineage(parts, "pieces"), parts_per_group)
    return sliced.join(starts, [*KEYS, "_slice"], "left").withColumn("start", F.coalesce("start", F.expr(UNKNOWN)))


def _folded(updates: DataFrame, last_only: bool) -> DataFrame:
    """(key, _slice, seq, type, state, k, address, via): the entry after each update that changed it, or after the last one."""

    def run(rows: pa.Table) -> pa.Table:
        start = rows.column("start")[0].as_py()
        member = (STATES[start["state"] - 1], start["k"], start["address"], start["via"]) if start["state"] else NOTHING
        out, seq, kind = [], None, None
        for seq, kind, inc, address, via in _updates(rows):
            member, changed = advance(member, kind, inc, address, via)
            if changed and not last_only:
                out.append((seq, kind, *member))
        if last_only:
            out.append((seq, kind, *member))
        own = rows.select(SLICE).take(pa.array([0] * len(out), pa.int64()))
        for i, (name, of) in enumerate(zip(names, types, strict=True)):
            own = own.append_column(name, pa.array([o[i] for o in out], of or rows.schema.field(name).type))
        return own

    names = ["seq", "type", "state", "k", "address", "via"]
    types = [None, None, pa.string(), pa.int64(), None, None]
    schema = f"{_types(updates, [*SLICE, 'seq', 'type'])}, state string, k long, {_types(updates, ['address', 'via'])}"
    return updates.groupBy(*SLICE).applyInArrow(run, schema)


def _foreign(gossip: DataFrame) -> DataFrame:
    return gossip.filter("peer_id <> observer").select(
        *KEYS,
        "seq",
        "type",
        # A removal has no number.
        F.coalesce(F.col("incarnation").cast("long"), F.lit(0)).alias("incarnation"),
        "address",
        F.col("from").alias("via"),
    )


def gossip_changes(
    gossip: DataFrame, rows_per_slice: int = UPDATES_PER_SLICE, parts_per_group: int = PARTS_PER_GROUP
) -> DataFrame:
    """Updates that changed an entry, with ``is_new`` where they made a peer known or revived it.

    ``gossip`` has observer, seq, type, peer_id, address, incarnation and from.  These are the
    updates worth passing on.
    """
    changes = _folded(_with_starts(gossip, rows_per_slice, parts_per_group), last_only=False)
    return changes.select(
        *KEYS, "seq", "type", (F.col("type") == "alive").alias("is_new"), "state", F.col("k").alias("incarnation"), "address"
    )


def membership(
    gossip: DataFrame, rows_per_slice: int = UPDATES_PER_SLICE, parts_per_group: int = PARTS_PER_GROUP
) -> DataFrame:
    """(observer, peer_id, state, incarnation, address, via) after all updates in ``seq`` order."""
    ends = _folded(_with_starts(gossip, rows_per_slice, parts_per_group), last_only=True)
    last = ends.groupBy(*KEYS).agg(F.max_by(F.struct("state", "k", "address", "via"), "_slice").alias("m"))
    return last.filter("m.state is not null").select(*KEYS, "m.state", F.col("m.k").alias("incarnation"), "m.address", "m.via")


def self_incarnations(gossip: DataFrame, initial: int = 0, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(observer, incarnation): an observer answers each suspicion of itself with max(own, given) + 1.

    With the j-th suspicion giving i(j), that is n + max(initial, i(j) - (j - 1)) over all n of them, so
    one running count and one maximum do.
    """
    suspicions = gossip.filter("peer_id = observer and type = 'suspect'").select("observer", "seq", "incarnation")
    numbered = running_sum(with_slices(suspicions, ["observer"], "seq", rows_per_slice), ["observer"], "seq", F.lit(1), "j")
    raised = numbered.groupBy("observer").agg(
        (F.count(F.lit(1)) + F.greatest(F.max(F.col("incarnation") - F.col("j") + 1), F.lit(initial))).alias("incarnation")
    )
    return gossip.select("observer").distinct().join(raised, "observer", "left").select(
        "observer", F.coalesce("incarnation", F.lit(initial)).cast("long").alias("incarnation")
    )


MEMBER_KINDS = {
    "alive": "state = 'Alive'",
    "dead": "state = 'Dead'",
    "removed": "state = 'Removed'",
    "server": "address is not null",
    "client_only": "address is null",
    "reconnectable": "state <> 'Removed' and address is not null",
}


def members_where(members: DataFrame, kind: str) -> DataFrame:
    return members.filter(MEMBER_KINDS[kind])


def members_by_kind(members: DataFrame) -> DataFrame:
    """(kind, observer, peer_id): a row for every kind a member is of, in one pass over the members."""
    kinds = F.array(*[F.when(F.expr(test), F.lit(kind)) for kind, test in MEMBER_KINDS.items()])
    return members.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), *KEYS)


def alive_snapshot(members: DataFrame, selves: DataFrame) -> DataFrame:
    """(observer, peer_id, incarnation, address): each observer itself and its alive members."""
    return selves.select("observer", F.col("observer").alias("peer_id"), "incarnation", "address").unionByName(
        members_where(members, "alive").select(*KEYS, "incarnation", "address")
    )
