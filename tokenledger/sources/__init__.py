"""Readers of transcripts, usage exports, price lists and bills."""
