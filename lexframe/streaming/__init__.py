"""The same operators over feeds that keep growing."""
