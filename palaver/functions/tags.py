"""Column functions over tag strings and arrays of tags.

A tag string is a run of atoms such as ``<f/>``, ``<e/>``, ``<rms id="3"/>`` or ``<rm-2/>`` on one word. Membership of an atom family is
containment of its opening (``<rm`` also hits ``<rms``), as scores over these tags are defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ten labels of the simple index, in their order
SIMPLE_LABELS = ("<f/><cc/>", "<f/><ct/>", "<f/><tc/>", "<f/><tt/>", "<e/><cc/>", "<e/><ct/>", "<e/><tc/>", "<e/><tt/>", "<rm-0/><cc/>", "<rm-0/><ct/>")

_UTTSEG = "<[ct]*/>"


def atoms(tag: Column) -> Column:
    """All atoms of a tag string, in order."""
    return F.regexp_extract_all(tag, F.lit("<.*?/>"), F.lit(0))


def uttseg_atom(tag: Column) -> Column:
    """The first utterance segmentation atom, or the empty string."""
    return F.regexp_extract(tag, f"({_UTTSEG})", 1)


def remove_uttseg(tag: Column) -> Column:
    return F.regexp_replace(tag, _UTTSEG, "")


def simple_label(tag: Column, uttseg: bool = False) -> Column:
    """Repair onset, edit term or fluent, with the segmentation atom if ``uttseg``."""
    label = F.when(tag.contains("<rm-"), "<rm-0/>").when(tag.contains("<e"), "<e/>").otherwise("<f/>")
    return F.concat(label, uttseg_atom(tag)) if uttseg else label


def simple_index(tag: Column) -> Column:
    """Index of the simple label with segmentation among the ten labels; null where it is none of them."""
    at = F.array_position(F.array(*map(F.lit, SIMPLE_LABELS)), simple_label(tag, uttseg=True))
    return F.when(at > 0, (at - 1).cast("int"))


def first_contained(tag: Column, vocabulary: tuple[str, ...]) -> Column:
    """Index of the first vocabulary entry that is a part of the tag; null if none is."""
    hits = F.filter(F.array(*(F.when(tag.contains(v), F.lit(i)) for i, v in enumerate(vocabulary))), lambda x: x.isNotNull())
    return F.get(hits, F.lit(0))


def continuation(is_first: Column, is_last: Column) -> Column:
    """Segmentation atom from a word's place in its utterance."""
    return F.concat(F.when(is_first, "<t").otherwise("<c"), F.when(is_last, "t/>").otherwise("c/>"))


def in_segment(tag: Column, state: Column) -> Column:
    """``x_STATE_y``: x and y say whether the utterance starts and ends at the word. Null if either side is not tagged."""
    head = F.when(tag.contains("<c"), "c_").when(tag.contains("<t"), "t_")
    tail = F.when(tag.contains("c/>"), "_c").when(tag.contains("t/>"), "_t")
    return F.concat(head, state, tail)


def simple_state(tag: Column) -> Column:
    return F.when(tag.contains("<f"), "f").when(tag.contains("<i"), "i").when(tag.contains("<e"), "e").when(tag.contains("<rm-"), "rpSE")


def simple_segment_state(tag: Column) -> Column:
    return in_segment(tag, simple_state(tag))


def segment_state(tag: Column) -> Column:
    return in_segment(tag, F.lit("w"))


def dialogue_act(tag: Column) -> Column:
    found = F.regexp_extract(tag, r'<diact type="([^\s]*?)"/>', 1)
    return F.when(found != "", found)


def act_segment_state(tag: Column) -> Column:
    return in_segment(tag, dialogue_act(tag))


def act_floor_state(tag: Column) -> Column:
    floor = F.regexp_extract(tag, r'speaker floor="([^\s]*?)"/>', 1)
    return F.when(floor != "", F.concat(dialogue_act(tag), F.lit("_"), floor))


def act_floor_segment_state(tag: Column) -> Column:
    return in_segment(tag, act_floor_state(tag))


def _state_after(previous: Column, tag: Column, segments: bool) -> Column:
    mid = previous.contains("rpSM") | previous.contains("rpM")
    if segments:
        mid = mid & ~tag.contains("<t") & ~tag.contains("t/>")
    state = (
        F.when(tag.contains("<f"), F.when(mid, "rpM").otherwise("f"))
        .when(tag.contains("<e") & ~tag.contains("<i"), "e")
        .when(tag.contains("<i"), "i")
        .when(tag.contains("<rm-"), F.when(tag.contains("<rpEnd"), "rpSE").otherwise("rpSM"))
        .when(tag.contains("<rpMid"), "rpM")
        .when(tag.contains("<rpEnd"), "rpE")
    )
    return in_segment(tag, state) if segments else state


def full_states(tags: Column, segments: bool = False) -> Column:
    """Markov states of an array of tags. A fluent word behind an open repair is mid-repair, so this folds from left to right."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc: Column, tag: Column) -> Column:
        state = _state_after(acc["last"], tag, segments)
        return F.struct(F.coalesce(state, F.lit("")).alias("last"), F.concat(acc["all"], F.array(state)).alias("all"))

    return F.aggregate(tags, start, step, lambda acc: acc["all"])


def remove_repairs(tag: Column, ids: Column) -> Column:
    """Without the atoms of the given repairs; a word whose only atoms go is an edit term if it was an interregnum, else fluent."""
    id_of = lambda a: F.regexp_extract(a, 'id="([0-9]+)"', 1)
    every = atoms(tag)
    left = F.array_join(F.filter(every, lambda a: (id_of(a) == "") | ~F.array_contains(ids, id_of(a))), "")
    return F.when(left != "", left).when(tag.contains("<i "), "<e/>").otherwise("<f/>")
