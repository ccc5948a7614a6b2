"""Results as files: reports, exports, manifests."""
