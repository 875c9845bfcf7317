"""Key services with clients that stand in for theirs."""

import base64
from types import SimpleNamespace

import pytest

from redactory.operators import keys, vault
from redactory.plans.errors import VaultError

turn = lambda raw: bytes(255 - x for x in raw)


class Aws:
    def encrypt(self, KeyId, Plaintext):
        return {"CiphertextBlob": turn(Plaintext)}

    def decrypt(self, KeyId, CiphertextBlob):
        return {"Plaintext": turn(CiphertextBlob)}


class Gcp:
    def encrypt(self, request):
        return SimpleNamespace(ciphertext=turn(request["plaintext"]))

    def decrypt(self, request):
        return SimpleNamespace(plaintext=turn(request["ciphertext"]))


class Azure:
    def encrypt(self, algorithm, plain):
        assert algorithm == "RSA-OAEP-256"
        return SimpleNamespace(ciphertext=turn(plain))

    def decrypt(self, algorithm, wrapped):
        return SimpleNamespace(plaintext=turn(wrapped))


def hashicorp():
    transit = SimpleNamespace(
        encrypt_data=lambda name, plaintext, mount_point: {"data": {"ciphertext": f"vault:v1:{plaintext[::-1]}"}},
        decrypt_data=lambda name, ciphertext, mount_point: {"data": {"plaintext": ciphertext.removeprefix("vault:v1:")[::-1]}},
    )
    return SimpleNamespace(secrets=SimpleNamespace(transit=transit))


def workos():
    return SimpleNamespace(vault=SimpleNamespace(encrypt=lambda data, key_context: data[::-1], decrypt=lambda encrypted_data: encrypted_data[::-1]))


SERVICES = [
    keys.AwsKms("k", client=Aws()), keys.GcpKms("projects/p/k", client=Gcp()), keys.AzureKeyVault("https://v", "k", client=Azure()),
    keys.HashiCorpVault("https://v", "t", "k", client=hashicorp()), keys.WorkOsEkm("a", {"org": "o"}, client=workos()),
]


@pytest.mark.parametrize("service", SERVICES, ids=lambda s: s.name)
def test_maps_are_sealed_by_a_service(spark, service):
    df = spark.createDataFrame([(1, {"[EMAIL_1]": "a@b.co"}), (2, None)], "id int, map map<string,string>")
    sealed = vault.seal(df, service)
    held = spark.createDataFrame(sealed.collect(), sealed.schema)
    blob = vault.blob_fields(held.where("id = 1").first().sealed)
    assert blob["provider"] == service.name and service.unwrap(spark, blob["encryptedDek"]) != base64.b64decode(base64.b64encode(b"x"))
    assert {r.id: r.map for r in vault.open_sealed(held, service).collect()} == {1: {"[EMAIL_1]": "a@b.co"}, 2: None}


def test_errors_of_services(spark):
    broken = keys.AwsKms("k", client=SimpleNamespace(encrypt=lambda **_: {"CiphertextBlob": b""}, decrypt=lambda **_: (_ for _ in ()).throw(OSError())))
    with pytest.raises(VaultError) as x:
        broken.wrap(spark, b"k" * 32)
    assert x.value.code == "VAULT_ENCRYPT_FAILED"
    with pytest.raises(VaultError) as x:
        broken.unwrap(spark, "eA==")
    assert x.value.code == "VAULT_DEK_DECRYPT_FAILED"
    with pytest.raises(VaultError):
        keys.KeyService().unwrap(spark, "x")
    with pytest.raises(VaultError):  # the package of a service that is not installed is an error of the vault's as well
        keys.WorkOsEkm("a", {}).wrap(spark, b"k" * 32)
