"""The SQL that says the same as a scanner, for checks against another engine.

That engine's word classes are ASCII, so letters beyond ASCII are first replaced by an underscore, a word character that is
no letter: boundaries then fall where they do in Unicode. A rule whose pattern needs lookaround has
its own SQL, or none; rules for scripts that the tables lack are left out of the SQL, so a hit would show as a difference.
"""

from __future__ import annotations

from quillmark.plans.rules import Scanner

#: A line of text for each rule family, added to a document by its id, so that every rule has something to find.
SNIPPETS = (
    "Bob: um, so OK (laughs) it took [0:12] two .", "gonna be alright, yeah, U.S.A. and e-mail (inaudible)", "[Inaudible] twenty dollars  and 50% off!", "He said habeus corpus, the plantiff and the subpena",
    "MS 5.0 mg qd then 10000 units x 5 d at 3 @ 4", "could of gone at 5 p.m. in June, 2020 -- the 70's", "you're own fault, it's turn, there house", "mm-hmm, mhm, 'cause doctor Smith and Mrs. Jones know",
    "01:12:04 and 01:00:00:31 (XX) 00:00:05:00", "Interviewer: dont say im sure, cant we", "Person 2: b-o-b [crosstalk] ____ etc.", "Q: 5 men saw... 12:13:14 [laughs] word-- ", "daß muß ich sagen, «oui» c'est", "text, comma and this, that is wrong — so",
    "- one\n- two\n3) three", "plain words without an end", "?Ann: ⚠ maybe this", "# DRAFT verify by ear", "Int. house, day", "music: soft", "So, I went. \"Yes\". Kinda wanna go",
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: injected(doc_id, lang, source, text) and lines(doc_id, lang, n, raw, text, body, body_legal, has_terminal).
VIEWS = f"""
injected AS (SELECT doc_id, lang, source, coalesce(text, '') || chr(10) || ([{', '.join(map(_quote, SNIPPETS))}])[CAST(doc_id % {len(SNIPPETS)} AS INT) + 1] AS text FROM documents),
parts AS (SELECT doc_id, lang, source, regexp_matches(text, '[。？.?]') AS has_terminal, regexp_split_to_array(text, '{LINE_ENDS}') AS p FROM injected),
trimmed AS (SELECT doc_id, lang, source, has_terminal, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM parts),
numbered AS (SELECT doc_id, lang, source, has_terminal, len(list_filter(p, lambda x: regexp_matches(x, '^\\s*(?:\\d+[.)]|[-*•])\\s+\\S'))) AS list_lines, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS raw FROM trimmed),
lines AS (SELECT doc_id, lang, source, has_terminal, list_lines, n, raw, regexp_replace(raw, '[^\\x00-\\x7F]', '_', 'g') AS text FROM numbered),
bodied AS (SELECT *, regexp_replace(text, '^\\s*[^:]{{1,40}}?:\\s', '') AS body, regexp_replace(text, '^\\s*(?:[A-Z][A-Z .''-]{{0,38}}|Q|A)\\s{{2,}}|^\\s*[^:]{{1,40}}?:\\s', '') AS body_legal FROM lines)
"""


def scanner_sql(scanner: Scanner) -> str | None:
    """(doc_id, line, rule, severity, evidence) of one scanner over the injected documents, or None."""
    branches = []
    for r in scanner.rules:
        if r.absent:
            continue
        if r.no_sql or (r.find is not None and r.sql is None) or (r.keep is not None and r.sql is None) or (r.evidence is not None and r.sql is None and r.evidence.__name__ != "trim"):
            return None
        if r.sql is not None:
            hits = r.sql
            if "raw" not in hits and any(ord(c) > 127 for c in hits) or "length(trim(text))" in hits or "substr(" in hits:  # looks at letters beyond ASCII or shows them
                hits = hits.replace("text", "raw") if "body" not in hits else hits.replace("rtrim(body)", "rtrim(regexp_replace(raw, '^\\s*[^:]{1,40}?:\\s', ''))")
        else:
            source = {"text": "text", "body": "body", "legal": "body_legal"}[r.scope]
            beyond = any(ord(c) > 127 for c in r.pattern) or "_" in r.pattern
            if beyond:
                if r.scope != "text":
                    source = "regexp_replace(raw, '^\\s*[^:]{1,40}?:\\s', '')"
                else:
                    source = "raw"
            rx = _quote(("(?i)" if r.fold else "") + r.pattern)
            if r.first:
                hits = f"CASE WHEN regexp_matches({source}, {rx}) THEN [regexp_extract({source}, {rx}, {r.group})] END"
            else:
                hits = f"regexp_extract_all({source}, {rx}, {r.group})"
            if r.evidence is not None:
                hits = f"list_transform({hits}, lambda x: trim(x))"
        branches.append(f"SELECT doc_id, CAST(n AS INT) AS line, {_quote(r.rule)} AS rule, {_quote(r.severity)} AS severity, unnest({hits}) AS evidence FROM bodied")
    return f"WITH {VIEWS.strip()}\n" + "\nUNION ALL ".join(branches) if branches else None
