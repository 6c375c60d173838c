"""Part of catlake."""
