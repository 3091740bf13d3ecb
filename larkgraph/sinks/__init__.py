"""Tables written for others to read: snapshots and mapping files."""
