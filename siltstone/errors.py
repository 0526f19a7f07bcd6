"""Errors by what the caller can do about them; each names the HTTP status a service would answer with."""

from __future__ import annotations


class SiltstoneError(Exception):
    status = 500


class Invalid(SiltstoneError, ValueError):
    """The request is wrong and will stay wrong."""

    status = 400


class NotFound(SiltstoneError):
    status = 404


class Conflict(SiltstoneError):
    """Another writer or an existing target is in the way."""

    status = 409


class Overloaded(SiltstoneError):
    """Too much unfolded log; compact and retry."""

    status = 429


class Unsupported(SiltstoneError, NotImplementedError):
    status = 501


class Unavailable(SiltstoneError):
    """A consistent answer cannot be given now."""

    status = 503
