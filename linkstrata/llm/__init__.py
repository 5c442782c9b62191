"""Preparation of evidence text for language-model training: operators over the evidence table.

An evidence row is what the rest of the library calls evidence: ``evidence_id``, ``url``, ``title``, ``snippet`` and so on. Each
operator names the columns it reads; all others are ignored, so extra columns cannot clash. Nothing else in the library imports
this subpackage.
"""
