"""JSON merge patch (RFC 7396) over ordered documents, and patches of patches."""

from __future__ import annotations

#: The one key of an object that replaces instead of merging. JSON patches can't say that, but a patch of patches must:
#: a scalar and then an object at the same place make a new object, whatever was there.
SET = "\0="


def patched(target, patch):
    """``patch`` (or a composed one) applied to ``target``: objects merge, a null removes its key, anything else
    replaces."""
    if not isinstance(patch, dict):
        return patch
    if SET in patch:
        return patch[SET]
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        elif isinstance(value, dict):
            out[key] = patched(out.get(key), value)
        else:
            out[key] = value
    return out


def composed(first, then):
    """One patch of the same effect as ``first`` and then ``then``: nulls stay, as they still have to remove."""
    if not isinstance(then, dict) or SET in then:
        return then
    if not isinstance(first, dict):
        return {SET: patched({}, then)}
    if SET in first:
        return {SET: patched(first[SET], then)}
    return first | {key: composed(first[key], value) if key in first else value for key, value in then.items()}
