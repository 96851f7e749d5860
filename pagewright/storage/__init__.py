"""Tables and indexes of their own in a shared folder: versioned commits, snapshots, postings, vectors."""
