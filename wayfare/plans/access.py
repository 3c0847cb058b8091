"""Who may read what: checks of a token's claims, before any query is planned."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Names of permissions.
RAW_DATA, LOCATIONS, OTHERS = "privilege:GetRawData", "privilege:GetLocationHistory", "privilege:GetNonLocationHistory"
DEVICE = re.compile(r"did:erc721:\d+:0x[0-9a-fA-F]{40}:\d+")


class Denied(PermissionError):
    pass


@dataclass(frozen=True)
class Claims:
    """What a verified token says: its subject, and the permissions on it."""

    subject: str
    permissions: frozenset[str] = field(default_factory=frozenset)

    def for_subject(self, subject: str) -> None:
        if subject != self.subject:
            raise Denied("the token is of another subject")

    def all_of(self, *needed: str) -> None:
        if missing := set(needed) - self.permissions:
            raise Denied(f"lacks {sorted(missing)}")

    def one_of(self, *needed: str) -> None:
        if not self.permissions & set(needed):
            raise Denied(f"needs one of {sorted(needed)}")

    def raw_data(self) -> None:
        """Raw data need their own permission, or both that together give all history."""
        if RAW_DATA not in self.permissions and not {LOCATIONS, OTHERS} <= self.permissions:
            raise Denied("no access to raw data")


def authorized(claims: Claims | None, subject: str, linked: Callable[[str], str | None] | None = None) -> str:
    """The subject whose raw events may be read: the token's own, or a device that `linked` (which asks for the vehicle of
    a device) ties to it. Whatever can't be told, an error of `linked` among it, is denied."""
    if claims is None:
        raise Denied("no claims")
    claims.raw_data()
    if subject == claims.subject:
        return subject
    if not DEVICE.fullmatch(subject) or linked is None:
        raise Denied("no access to this subject")
    try:
        vehicle = linked(subject)
    except Exception as e:
        raise Denied("no access to this subject") from e
    if vehicle != claims.subject:
        raise Denied("no access to this subject")
    return subject
