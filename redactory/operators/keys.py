"""Key services that wrap the vault's data keys. Each makes its client when it is first used, so no package is needed before;
a client that is given instead may be anything with the same calls.

The data key travels as base64 text, which every service takes; what goes wrong there becomes a vault error.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import SparkSession

from redactory.plans.errors import VaultError


class KeyService:
    """What services share: the client made once, and errors with the vault's codes. Subclasses say how to encrypt and decrypt a few bytes."""

    name = ""

    def __init__(self, client: object | None = None):
        self._client = client

    def connect(self) -> object:
        raise VaultError("VAULT_INVALID_KEY")

    @property
    def client(self) -> object:
        if self._client is None:
            self._client = self.connect()
        return self._client

    def encrypt(self, plain: bytes) -> str:
        raise VaultError("VAULT_ENCRYPT_FAILED")

    def decrypt(self, wrapped: str) -> bytes:
        raise VaultError("VAULT_DEK_DECRYPT_FAILED")

    def wrap(self, spark: SparkSession, key: bytes) -> str:
        return self._told("VAULT_ENCRYPT_FAILED", lambda: self.encrypt(base64.b64encode(key)))

    def unwrap(self, spark: SparkSession, wrapped: str) -> bytes:
        return self._told("VAULT_DEK_DECRYPT_FAILED", lambda: base64.b64decode(self.decrypt(wrapped), validate=True))

    def _told(self, code: str, run: Callable[[], str | bytes]) -> str | bytes:
        try:
            out = run()
        except VaultError:
            raise
        except Exception as x:
            raise VaultError(code) from x
        if not out:
            raise VaultError(code)
        return out


def _text(raw: bytes | None) -> str:
    return base64.b64encode(bytes(raw or b"")).decode()


class AwsKms(KeyService):
    """A key of AWS KMS; ``options`` go to the client (region_name, endpoint_url, credentials)."""

    name = "aws-kms"

    def __init__(self, key_id: str, client: object | None = None, **options: str):
        super().__init__(client)
        self.key_id, self.options = key_id, options

    def connect(self) -> object:
        import boto3

        return boto3.client("kms", **self.options)

    def encrypt(self, plain: bytes) -> str:
        return _text(self.client.encrypt(KeyId=self.key_id, Plaintext=plain)["CiphertextBlob"])

    def decrypt(self, wrapped: str) -> bytes:
        return self.client.decrypt(KeyId=self.key_id, CiphertextBlob=base64.b64decode(wrapped))["Plaintext"]


class GcpKms(KeyService):
    """A key of Google Cloud KMS, by its full resource name."""

    name = "gcp-kms"

    def __init__(self, key_name: str, client: object | None = None):
        super().__init__(client)
        self.key_name = key_name

    def connect(self) -> object:
        from google.cloud import kms

        return kms.KeyManagementServiceClient()

    def encrypt(self, plain: bytes) -> str:
        return _text(self.client.encrypt(request={"name": self.key_name, "plaintext": plain}).ciphertext)

    def decrypt(self, wrapped: str) -> bytes:
        return self.client.decrypt(request={"name": self.key_name, "ciphertext": base64.b64decode(wrapped)}).plaintext


class AzureKeyVault(KeyService):
    """An RSA key of Azure Key Vault."""

    name = "azure-key-vault"
    #: Fixed value: the algorithm that keys are wrapped by.
    ALGORITHM = "RSA-OAEP-256"

    def __init__(self, vault_url: str, key_name: str, credential: object | None = None, client: object | None = None):
        super().__init__(client)
        self.vault_url, self.key_name, self.credential = vault_url, key_name, credential

    def connect(self) -> object:
        from azure.identity import DefaultAzureCredential
        from azure.keyvault.keys import KeyClient
        from azure.keyvault.keys.crypto import CryptographyClient

        credential = self.credential or DefaultAzureCredential()
        return CryptographyClient(KeyClient(self.vault_url, credential).get_key(self.key_name), credential)

    def encrypt(self, plain: bytes) -> str:
        return _text(self.client.encrypt(self.ALGORITHM, plain).ciphertext)

    def decrypt(self, wrapped: str) -> bytes:
        return self.client.decrypt(self.ALGORITHM, base64.b64decode(wrapped)).plaintext


class HashiCorpVault(KeyService):
    """A key of a transit engine of HashiCorp Vault."""

    name = "hashicorp-vault"

    def __init__(self, url: str, token: str, key_name: str, mount: str = "transit", client: object | None = None):
        super().__init__(client)
        self.url, self.token, self.key_name, self.mount = url, token, key_name, mount

    def connect(self) -> object:
        import hvac

        return hvac.Client(url=self.url, token=self.token)

    def encrypt(self, plain: bytes) -> str:
        return self.client.secrets.transit.encrypt_data(name=self.key_name, plaintext=_text(plain), mount_point=self.mount)["data"]["ciphertext"]

    def decrypt(self, wrapped: str) -> bytes:
        return base64.b64decode(self.client.secrets.transit.decrypt_data(name=self.key_name, ciphertext=wrapped, mount_point=self.mount)["data"]["plaintext"])


class WorkOsEkm(KeyService):
    """WorkOS Vault, whose keys go by a context."""

    name = "workos-ekm"

    def __init__(self, api_key: str, context: dict[str, str], client: object | None = None):
        super().__init__(client)
        self.api_key, self.context = api_key, dict(context)

    def connect(self) -> object:
        from workos import WorkOSClient

        return WorkOSClient(api_key=self.api_key)

    def encrypt(self, plain: bytes) -> str:
        return self.client.vault.encrypt(data=plain.decode(), key_context=self.context)

    def decrypt(self, wrapped: str) -> bytes:
        return self.client.vault.decrypt(encrypted_data=wrapped).encode()
