"""Sources and sinks: notes, chats, datasets, files, vector caches, snapshots, a pull-style data source."""
