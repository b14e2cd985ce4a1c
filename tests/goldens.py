"""Inputs and the results that name functions must give."""

# Rules of the transform cases, (is a regular expression, from, to).
RULES = (
    (False, "__jump_table::_strcasecmp", "SStrCmp"),
    (False, "__jump_table::strchr", "SStrChr"),
    (False, "__jump_table::strcpy", "SStrCopy"),
    (False, "__jump_table::strlen", "SStrLen"),
    (False, "__jump_table::strncasecmp", "SStrCmpI"),
    (False, "__jump_table::strrchr", "SStrChrR"),
    (False, "__jump_table::strstr", "SStrStr"),
    (False, "__jump_table::", ""),
    (False, "_SErr", "SErr"),
    (False, "SE3", "SE2"),
    (False, "SI3", "SI2"),
    (False, "CWorldMap", "CMap"),
    (False, "WowClientDB2", "WowClientDB"),
    (False, "::", "__"),
    (True, r"\b(struct|class)_", ""),
    (True, r"(\w+)<([^,>]+)[^>]*>", "$1__$2"),
    (True, r"(\w+)(.*?)(::|__)\1$", "$1$2$3constructor"),
    (True, r"(\w+)(.*?)(::|__)~\1$", "$1$2$3destructor"),
    (True, r"(\w+)<([^<>,]+)[^<>]*>", "$1__$2"),
    (True, r"(\w+)<([^<>,]+)[^<>]*>", "$1__$2"),
    (False, "TSFixedArray_", "TSGrowableArray_"),
    (False, "__", "_"),
)

# Transform.
TRANSFORM = (
    ("GLWorker::GLWorker", "GLWorker_constructor"),
    ("CSplineParticleEmitter::~CSplineParticleEmitter", "CSplineParticleEmitter_destructor"),
    ("TSGrowableArray<CXMLAttribute>::SetCount", "TSGrowableArray_CXMLAttribute_SetCount"),
    ("DBCache<WardenCachedModule,CWardenKey,CWardenKey>::Save", "DBCache_WardenCachedModule_Save"),
    ("DBCache<PageTextCache_C,int,HASHKEY_INT>::AddItems", "DBCache_PageTextCache_C_AddItems"),
    ("TSHashTable<OVERRIDE_SPELLCAST_BY_NAME_NODE,HASHKEY_UTF8I>::Ptr", "TSHashTable_OVERRIDE_SPELLCAST_BY_NAME_NODE_Ptr"),
    ("TSSimpleArray<TSExplicitList<SOUNDKITLOOKUP,-572662307>>::FatalArrayBounds", "TSSimpleArray_TSExplicitList_SOUNDKITLOOKUP_FatalArrayBounds"),
    ("TSFixedArray<TSExplicitList<SOUNDKITLOOKUP,-572662307>>::ReallocData", "TSGrowableArray_TSExplicitList_SOUNDKITLOOKUP_ReallocData"),
    ("TSHashTable<struct_FILEMAP,class_HASHKEY_STRI>::InternalClear", "TSHashTable_FILEMAP_InternalClear"),
    ("Battlenet::MatchMaker::MapSpec::MapSpec", "Battlenet_MatchMaker_MapSpec_constructor"),
    ("CDynamicString::operator=", "CDynamicString_operator_assign"),
    ("CDynamicString::operator+=", "CDynamicString_operator_add_on_assign"),
    ("WowTime::operator<", "WowTime_operator_lt"),
    ("WowTime::operator>", "WowTime_operator_gt"),
    ("WowTime::operator==", "WowTime_operator_eq"),
    ("WowTime::operator>=", "WowTime_operator_ge"),
    ("WowTime::operator<=", "WowTime_operator_le"),
    ("SI3::DSP_AttachCustomDspChain", "SI2_DSP_AttachCustomDspChain"),
    ("SI3::DSP_UpdateDsp", "SI2_DSP_UpdateDsp"),
    ("SI3DspChainHead::DestroyChain", "SI2DspChainHead_DestroyChain"),
    ("SE3::GetInputDriverName_Cached", "SE2_GetInputDriverName_Cached"),
    ("SE3::CacheEventCallback", "SE2_CacheEventCallback"),
    ("SE3CaptureCallbacks::~SE3CaptureCallbacks", "SE2CaptureCallbacks_destructor"),
    ("TSExplicitList<SE3SoundChunk,-572662307>::TSExplicitList", "TSExplicitList_SE2SoundChunk_constructor"),
    ("__jump_table::_strcasecmp", "SStrCmp"),
    ("__jump_table::strchr", "SStrChr"),
    ("__jump_table::strcpy", "SStrCopy"),
    ("__jump_table::strlen", "SStrLen"),
    ("__jump_table::strncasecmp", "SStrCmpI"),
    ("__jump_table::strrchr", "SStrChrR"),
    ("__jump_table::strstr", "SStrStr"),
    ("__jump_table::_memmove", "_memmove"),
    ("_SErrGetErrorStr", "SErrGetErrorStr"),
    ("_SErrGetLastError", "SErrGetLastError"),
    ("_SErrSetLastError", "SErrSetLastError"),
    ("_SErrSetLogCallback", "SErrSetLogCallback"),
    ("WowClientDB2<KeyChainRec_C>::WowClientDB2", "WowClientDB_KeyChainRec_C_constructor"),
    ("WowClientDB2<KeyChainRec_C>::GetRecordByIndex", "WowClientDB_KeyChainRec_C_GetRecordByIndex"),
    ("WowClientDB2<KeyChainRec_C>::IterateOverCache", "WowClientDB_KeyChainRec_C_IterateOverCache"),
    ("CMoveSpline::~CMoveSpline", "CMoveSpline_destructor"),
    ("TSHashTable<DBCache<ItemTextCache_C, unsigned long long, CHashKeyGUID>::DBCACHEHASH, CHashKeyGUID>::New", "TSHashTable_DBCache_ItemTextCache_C_DBCACHEHASH_New"),
    ("MyClass::operator[]", "MyClass_operator_subscript"),
)

# Filter with the parts GLWorker, std:: and TSSimpleArray.
FILTER = (
    ("GLWorker::GLWorker", True),
    ("MyClass::operator+", False),
    ("/usr/lib/libstdc++.6.dylib::std::ostream::_M_insert<unsigned_long_long>", True),
    ("/usr/lib/libstdc++.6.dylib::std::ostream::_M_insert<void_const*>", True),
    ("std::vector<char_const*,std::allocator<char_const*>>::_M_insert_aux", True),
    ("std::vector<unsigned_int,std::allocator<unsigned_int>>::_M_insert_aux", True),
    ("std::vector<System_SFile::ListfileEntry,std::allocator<System_SFile::ListfileEntry>>::_M_insert_aux", True),
    ("TSSimpleArray<CMapObjDefGroup*>::FatalArrayBounds(unsigned long) const", True),
)

# Demangle.
DEMANGLE = (
    ("_ZN11TSHashTableIN7DBCacheI17GameObjectStats_Ci11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<GameObjectStats_C, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI9NameCachey12CHashKeyGUIDE11DBCACHEHASHES2_E3NewEjRKS2_mm", "TSHashTable<DBCache<NameCache, unsigned long long, CHashKeyGUID>::DBCACHEHASH, CHashKeyGUID>::New"),
    ("_ZN11TSHashTableIN7DBCacheI7NPCTexti11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<NPCText, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI15PageTextCache_Ci11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<PageTextCache_C, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI12PetNameCachei11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<PetNameCache, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI10CGPetitioni11HASHKEY_INTE11DBCACHEHASHES2_E15InternalNewNodeEjmm", "TSHashTable<DBCache<CGPetition, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::InternalNewNode"),
    ("_ZN11TSHashTableIN7DBCacheI14ArenaTeamCachei11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<ArenaTeamCache, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI10DanceCachei11HASHKEY_INTE11DBCACHEHASHES2_E15InternalNewNodeEjmm", "TSHashTable<DBCache<DanceCache, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::InternalNewNode"),
    ("_ZN11TSHashTableIN7DBCacheI15CreatureStats_Ci11HASHKEY_INTE11DBCACHEHASHES2_E15InternalNewNodeEjmm", "TSHashTable<DBCache<CreatureStats_C, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::InternalNewNode"),
    ("_ZN11TSHashTableIN7DBCacheI12PetNameCachei11HASHKEY_INTE11DBCACHEHASHES2_E15InternalNewNodeEjmm", "TSHashTable<DBCache<PetNameCache, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::InternalNewNode"),
    ("_ZN11TSHashTableIN7DBCacheI7NPCTexti11HASHKEY_INTE11DBCACHEHASHES2_E15InternalNewNodeEjmm", "TSHashTable<DBCache<NPCText, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::InternalNewNode"),
    ("_ZN6TSListI15DBCACHECALLBACK9TSGetLinkIS0_EE5ClearEv", "TSList<DBCACHECALLBACK, TSGetLink<DBCACHECALLBACK>>::Clear"),
    ("_ZN11TSHashTableIN7DBCacheI10DanceCachei11HASHKEY_INTE11DBCACHEHASHES2_E3PtrEjRKS2_", "TSHashTable<DBCache<DanceCache, int, HASHKEY_INT>::DBCACHEHASH, HASHKEY_INT>::Ptr"),
    ("_ZN11TSHashTableIN7DBCacheI15ItemTextCache_Cy12CHashKeyGUIDE11DBCACHEHASHES2_E3NewEjRKS2_mm", "TSHashTable<DBCache<ItemTextCache_C, unsigned long long, CHashKeyGUID>::DBCACHEHASH, CHashKeyGUID>::New"),
    ("_ZN11CMoveSplineD1Ev", "CMoveSpline::~CMoveSpline"),
    ("_Z13GetGuildColorI11WowClientDBI19GuildColorBorderRecEEiT_hR9CImVector", "GetGuildColor<WowClientDB<GuildColorBorderRec>>"),
    ("_Z15AdvanceAndParseI13OnSizeChanged10linkObjectEbPT0_R8MemBlock", "AdvanceAndParse<OnSizeChanged, linkObject>"),
    ("_ZN11CWorldQueryC2Ev", "CWorldQuery::CWorldQuery"),
)
