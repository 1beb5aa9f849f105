"""URL pieces and reference resolution (RFC 3986) as SQL expressions."""

from __future__ import annotations

from leafmill.functions.sqltext import fold, let, quote

_SCHEME = quote(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_AUTHORITY = quote(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)")
_PARTS = quote(r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")


def scheme_of(url: str) -> str:
    return f"lower(regexp_extract({url}, {_SCHEME}, 1))"


def authority_of(url: str) -> str:
    """Lower-cased host, with port and user part if written."""
    return f"lower(regexp_extract({url}, {_AUTHORITY}, 1))"


def origin_of(url: str) -> str:
    return f"concat({scheme_of(url)}, '://', regexp_extract({url}, {_AUTHORITY}, 1), '/')"


def is_web_url(url: str) -> str:
    return f"({scheme_of(url)} IN ('http', 'https'))"


def split_url(url: str) -> str:
    """Scheme, authority (case kept), path, query and fragment as a struct."""
    names = ("authority", "path", "query", "fragment")
    parts = [f"regexp_extract({url}, {_PARTS}, {i}) AS {name}" for i, name in enumerate(names, 1)]
    return f"struct({scheme_of(url)} AS scheme, {', '.join(parts)})"


def _joined(scheme: str, authority: str, path: str, query: str, fragment: str) -> str:
    return (
        f"concat({scheme}, '://', {authority}, CASE WHEN {path} = '' OR startswith({path}, '/') THEN {path} "
        f"ELSE concat('/', {path}) END, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END, "
        f"CASE WHEN {fragment} = '' THEN '' ELSE concat('#', {fragment}) END)"
    )


def _without_dots(path: str) -> str:
    """Remove ``.`` and ``..`` segments."""

    def step(done: str, segment: str) -> str:
        return (
            f"CASE WHEN {segment} = '..' THEN slice({done}, 1, greatest(size({done}) - 1, 0)) "
            f"WHEN {segment} = '.' THEN {done} ELSE array_append({done}, {segment}) END"
        )

    def collapsed(parts: str) -> str:
        kept = fold(parts, "CAST(array() AS ARRAY<STRING>)", step)
        closed = f"CASE WHEN element_at({parts}, -1) IN ('.', '..') THEN array_append({kept}, '') ELSE {kept} END"
        return let(f"array_join({closed}, '/')", lambda p: f"CASE WHEN {p} = '' THEN '/' ELSE {p} END")

    dotted = quote(r"(?:^|/)\.\.?(?:/|$)")
    return f"CASE WHEN regexp_like({path}, {dotted}) THEN {let(f'split({path}, {quote(chr(47))}, -1)', collapsed)} ELSE {path} END"


def _merged_path(base_path: str, path: str) -> str:
    """Path of the base up to its last slash, then the reference; no empty middle parts."""
    folder = f"regexp_replace({base_path}, '[^/]*$', '')"
    return f"regexp_replace(concat(coalesce(nullif({folder}, ''), '/'), {path}), '/{{2,}}', '/')"


def resolve(base: str, reference: str, base_parts: str | None = None) -> str:
    """Absolute form of ``reference`` as seen from the page ``base``.

    A caller with many references on one page passes ``base_parts``, the base split once.
    """
    cleaned = f"regexp_replace({reference}, {quote(r'^[\x00-\x20]+|[\t\r\n]+')}, '')"

    def against(ref: str) -> str:
        def parts(b: str, r: str) -> str:
            same = _joined(f"{b}.scheme", f"{r}.authority", f"{r}.path", f"{r}.query", f"{r}.fragment")
            query = f"CASE WHEN {r}.query <> '' THEN {r}.query ELSE {b}.query END"
            here = let(query, lambda q: _joined(f"{b}.scheme", f"{b}.authority", f"{b}.path", q, f"{r}.fragment"))
            target = (
                f"CASE WHEN startswith({r}.path, '/') THEN {r}.path ELSE {_merged_path(f'{b}.path', f'{r}.path')} END"
            )
            clean = let(target, _without_dots)
            there = let(
                clean, lambda p: _joined(f"{b}.scheme", f"{b}.authority", p, f"{r}.query", f"{r}.fragment")
            )
            return (
                f"CASE WHEN {r}.scheme <> '' AND {r}.scheme <> {b}.scheme THEN {ref} WHEN {r}.authority <> '' THEN {same} "
                f"WHEN {r}.path = '' THEN {here} ELSE {there} END"
            )

        split = base_parts or split_url(base)
        both = f"struct({split} AS b, {split_url(ref)} AS r)"
        return f"CASE WHEN {ref} = '' THEN {base} ELSE {let(both, lambda s: parts(f'{s}.b', f'{s}.r'))} END"

    return let(cleaned, against)
