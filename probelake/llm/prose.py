"""The running prose of a commit message, whatever tool wrote the commit down."""

from __future__ import annotations

import json
import re

_DIFF = re.compile(r"^(?:diff --git |diff -r |Index: |--- a/|GIT binary patch|Binary files )")
_HEAD = re.compile(r"^[A-Za-z][\w -]*: ")
_TRAILER = re.compile(r"^\s*(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)*|[a-z]+(?:-[a-z]+)+):\s+\S|^\s*\(cherry picked from |^\s*\(backported from |^\s*This reverts commit |^\s*git-svn-id:")
_LIST = re.compile(r"^\s*#?\s*(?:Conflicts|Changed paths|Files|Changed files|Modified|Added|Removed|Deleted):\s*$", re.I)
_PATH = re.compile(r"^\s*(?:[-*#+]\s*)?(?:[AMDRCU]\d*\s+)?[\w.@+-]*/?(?:[\w.@+-]+/)*[\w@+-]+\.[\w]+\s*(?:\|.*)?$|^\s*(?:[-*#+]\s*)?(?:[AMDRCU]\d*\s+)?(?:[\w.@+-]*/)+[\w.@+-]*\s*(?:\|.*)?$")
_STAT = re.compile(r"^\s*\d+ files? changed|^\s*(?:create|delete) mode \d+|^\s*rename ")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_CODE = re.compile(r"`[^`\n]*`|<[^<>\n]{1,60}>|\bhttps?://\S+|\bwww\.\S+|\(see #\d+\)|#\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_OTHER = re.compile(r"[\d_/\\(){}\[\]=<>|@#$%^&*+~]|[a-z][A-Z]|\w\.\w")


def message_of(text: str) -> tuple[str, list[str]]:
    """(subject, body lines) of a commit in the form of git log, a mail patch, a log with revision rules, a changeset or a JSON record; of anything else, its lines before a diff."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip("\n﻿")
    if text.lstrip().startswith("{"):
        try:
            record = json.loads(text)
            message = record.get("message") or record.get("msg") or record.get("description") or ""
            return _subject_first(str(message).split("\n"))
        except (ValueError, AttributeError):
            pass
    lines = text.split("\n")
    first = lines[0]
    if first.startswith("commit ") and len(lines) > 1:
        at = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        body = []
        for x in lines[at + 1 :]:
            if x and not x[0].isspace() and (_DIFF.match(x) or x.startswith("commit ")):
                break
            body.append(x[4:] if x.startswith("    ") else x.lstrip("\t"))
        return _subject_first(body)
    if first.startswith("From ") or (_HEAD.match(first) and any(x.startswith("Subject: ") for x in lines[:20])):
        at = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        subject = " ".join(x.split("Subject: ")[-1].strip() for i, x in enumerate(lines[:at]) if x.startswith("Subject: ") or (x[:1] == " " and i and any(y.startswith("Subject: ") for y in lines[:i])))
        body = []
        for x in lines[at + 1 :] if not any(x.rstrip() == "---" for x in lines[:at]) else []:
            if x.rstrip() in ("---", "--") or _DIFF.match(x):
                break
            body.append(x)
        return subject, body
    if first.startswith("-----") and len(lines) > 1:
        at = 2
        if len(lines) > 2 and lines[2].startswith("Changed paths"):
            at = next((i for i, x in enumerate(lines) if i > 2 and not x.strip()), len(lines))
        return _subject_first(_before_diff(lines[at:], also="-----"))
    if first.startswith("changeset:"):
        at = next((i for i, x in enumerate(lines) if x.startswith(("description:", "summary:"))), len(lines))
        rest = lines[at].split(":", 1)[1].strip() if at < len(lines) else ""
        return _subject_first(([rest] if rest else []) + _before_diff(lines[at + 1 :], also="changeset:"))
    return _subject_first(_before_diff(lines))


def _before_diff(lines: list[str], also: str = "\0") -> list[str]:
    at = next((i for i, x in enumerate(lines) if _DIFF.match(x) or x.startswith(also)), len(lines))
    return lines[:at]


def _subject_first(lines: list[str]) -> tuple[str, list[str]]:
    at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    return (lines[at].strip() if at < len(lines) else ""), lines[at + 1 :]


def prose_words(lines: list[str]) -> list[str]:
    """The words of running prose of a body in lower case: without trailers, file lists, code, links and numbers."""
    kept, listing = [], False
    for line in lines:
        if _LIST.match(line):
            listing = True
            continue
        if listing and line.strip() and (line[0].isspace() or line[:1] in "#-*" or _PATH.match(line)):
            continue
        listing = False
        if _TRAILER.match(line) or _STAT.match(line) or _PATH.match(line) or _DIFF.match(line):
            continue
        kept.append(_BULLET.sub("", line))
    words = []
    for token in _CODE.sub(" ", "\n".join(kept)).split():
        bare = token.strip(".,;:!?\"'“”‘’()[]*")
        if not _OTHER.search(bare):
            words += (w.lower().replace("’", "'") for w in _WORD.findall(bare))
    return words
