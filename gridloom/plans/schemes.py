"""Compression schemes: their numbers in file headers and what each is made of."""

from __future__ import annotations

from dataclasses import dataclass

#: Scheme numbers of the container formats, in order.
NAMES = (
    "AdaptiveCoarsening",
    "TrimmedMultiResResiduals",
    "PrefixExtraction",
    "PrefixExtractionPlainSuffixes",
    "MultiResExtraction",
    "EmbeddedPrefixExtraction",
    "EmbeddedPrefixExtractionTrimmedSuffixes",
    "EmbeddedMultiResExtractionLinReconstruction",
    "LossyEmbeddedMultiResExtractionNearestNeighborReconstruction",
    "EmbeddedPrefixExtractionPlainSuffixes",
    "EmbeddedQuantizedPrefixExtraction",
    "EmbeddedMultiResExtraction",
    "EmbeddedTrimmedMultiResExtraction",
    "EmbeddedMultiResExtractionTrimmedResiduals",
    "_TestEmbeddedPCP4Extraction",
    "_TestPCP4Extraction",
    "PatchPrefixExtractionPlainSuffixes",
    "PatchMultiResExtraction",
)
CODES = {name: k for k, name in enumerate(NAMES)}


@dataclass(frozen=True)
class Composition:
    """Grid walk (patch, embedded or adaptive mesh), coarsening step, and whether it restores every bit."""

    walk: str
    step: str
    lossless: bool


COMPOSITION = {
    "AdaptiveCoarsening": Composition("amr", "coarsening", False),
    "TrimmedMultiResResiduals": Composition("amr", "trimmed", False),
    "PrefixExtraction": Composition("amr", "prefix", True),
    "PrefixExtractionPlainSuffixes": Composition("amr", "prefix", True),
    "MultiResExtraction": Composition("amr", "multires", True),
    "EmbeddedPrefixExtraction": Composition("embedded", "prefix", True),
    "EmbeddedPrefixExtractionPlainSuffixes": Composition("embedded", "prefix", True),
    "EmbeddedMultiResExtraction": Composition("embedded", "multires", True),
    "EmbeddedQuantizedPrefixExtraction": Composition("embedded", "quantized", False),
    "EmbeddedTrimmedMultiResExtraction": Composition("embedded", "trimmed", False),
    "_TestEmbeddedPCP4Extraction": Composition("embedded", "xor", True),
    "_TestPCP4Extraction": Composition("amr", "xor", True),
    "PatchPrefixExtractionPlainSuffixes": Composition("patch", "prefix", True),
    "PatchMultiResExtraction": Composition("patch", "multires", True),
}
