"""Page snapshots, exports, the seen store and JSON results."""
