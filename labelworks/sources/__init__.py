"""Reading and writing: item files, coder sheets, codebooks, exports, snapshots."""
