"""Errors with stable codes, and their problem-details form."""

from __future__ import annotations

# Codes and default HTTP statuses.
CODES = {
    "INVALID_CONFIG": (400, "A setting or an input does not have the shape it should."),
    "UNKNOWN_RULE": (400, "No rule or preset goes by a name that was given."),
    "EMPTY_POLICY": (400, "A policy needs a rule that is on."),
    "INPUT_LIMIT": (413, "A text is longer than the limit for whole texts."),
    "DETECTOR_CONTRACT": (500, "A detector did what its declaration rules out."),
    "POLICY_CONFLICT": (409, "Presets disagree about a rule; say under rules which setting counts."),
    "STREAM_UNSUPPORTED": (400, "A rule that is on cannot work on streams."),
    "BUFFER_LIMIT": (413, "A stream held back more text than its buffer may hold."),
    "SOURCE_FAILURE": (424, "What feeds the stream failed."),
    "CANCELLED": (499, "The work was called off."),
}
VAULT_CODES = {
    "VAULT_ENCRYPT_FAILED": "Could not encrypt for the vault.",
    "VAULT_DECRYPT_FAILED": "Could not decrypt what the vault holds.",
    "VAULT_INVALID_KEY": "A key must be 32 bytes or a passphrase.",
    "VAULT_INVALID_SEALED_BLOB": "Not a sealed blob, or one of another version.",
    "VAULT_PROVIDER_MISMATCH": "Another provider sealed this blob.",
    "VAULT_DEK_GENERATION_FAILED": "Could not make a data key.",
    "VAULT_DEK_DECRYPT_FAILED": "Could not unwrap a data key.",
}


class RedactionError(Exception):
    """Message and path hold no values of the caller's."""

    def __init__(self, code: str, path: str | None = None, info: dict | None = None):
        super().__init__(CODES[code][1])
        self.code, self.path, self.info = code, path, info

    def problem(self, statuses: dict[str, int] | None = None) -> dict:
        """A problem-details record; of the statuses from 500 on only 500 itself may be given."""
        status = (statuses or {}).get(self.code, CODES[self.code][0])
        if status > 500:
            raise ValueError(f"status {status}: 500 is the only one of its class that is permitted")
        out = {"type": f"urn:redactory:error:{self.code.lower()}", "title": self.code, "status": status, "detail": CODES[self.code][1], "code": self.code}
        return out | ({"path": self.path} if self.path is not None else {}) | (self.info or {})


class VaultError(Exception):
    def __init__(self, code: str):
        super().__init__(VAULT_CODES[code])
        self.code = code
